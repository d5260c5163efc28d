"""Registered queries of the package and their SQL twins."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment, chat_windows, decontaminate, exact_dedup, language_id, line_dedup, ngram_join, packing, periodic, rlz_dedup,
    secrets, suffix_dedup, token_counts,
)
from .common import table

BASE_KINDS = ("assign", "access", "hex")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(language_id.learnable(docs))
    return language_id.predict(docs.select("doc_id", "text", language_id.held_out().alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are left of every document, as a digest."""
    return line_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that are left of every document."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stands for its group of equal texts."""
    return exact_dedup.mark(table(spark, sf_dir, "documents"), ["doc_id"])


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share most of their 4-word shingles."""
    return ngram_join.link(table(spark, sf_dir, "documents"), words=4, percent=85).select(
        "doc_id", "n_shingles", "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after personal data is replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count(token_counts.personal_edits(docs)).drop("text")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are left of every document."""
    return rlz_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, with the weak candidates that are linked."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*kinds):
        return F.filter("secrets", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(of(*BASE_KINDS)), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers lie over each other in every document."""
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False).withColumnRenamed(
        "groups", "groups_sha256")


def op12_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that quotes control strings, as read back from its windows."""
    quoted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_windows.read_back(chat_windows.windows(convs.union(quoted)))


def planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with words in which every tenth document, by its hash, is made periodic from a place on.

    Word i >= a becomes word a + (i - a) % p of the document. A document without doc_id is left alone.
    """
    hashed = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    chosen = F.col("h") % 10 == 0
    words = hashed.withColumn("w", F.when(chosen, F.regexp_extract_all(
        F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n, g = F.size("w").cast("long"), F.floor(F.col("h") / 10)
    placed = words.withColumn("a", F.when(n > 0, g % n)).withColumn(
        "p", F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + g % 8)))
    unit = F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), (n - F.col("a")).cast("int"))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), again), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document and the texts without repetitions, as digests."""
    found = periodic.collapse(planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"])))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start"), (-F.col("best.col1")).alias("length"),
        F.col("best.period"), F.floor(F.lit(1000) * -F.col("best.col1") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_language_id, op2_line_dedup, op3_suffix_dedup, op4_packing, op5_exact_dedup, op6_ngram_join, op7_token_counts,
    op8_substring_dedup, op9_decontamination, op10_secret_scan, op11_tokenizer_alignment, op12_chat_windows,
    op13_periodic_runs)}

#: Fixed value: what counts as white space in the contracts, as a class of a regular expression.
BLANK = r"[\x20\x09-\x0D]"

ORACLES: dict[str, str] = {
    "op2_line_dedup": """
        WITH lines AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        windows AS (
            SELECT doc_id, i AS p, l[i:i + 2] AS w FROM (
                SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM lines WHERE len(l) >= 3)),
        later AS (
            SELECT doc_id, p FROM windows
            QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, p) > 1),
        gone AS (SELECT DISTINCT doc_id, p + k AS line FROM later, (SELECT unnest([0, 1, 2]) AS k)),
        runs AS (
            SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE NOT EXISTS (
                SELECT 1 FROM gone h WHERE h.doc_id = g.doc_id AND h.line = g.line - 1)) AS spans,
                list(line) AS lines FROM gone g GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_lines, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
            sha256(array_to_string([x for x, i in l IF NOT list_contains(coalesce(lines, []), i)], chr(10))) AS kept_sha256
        FROM lines d LEFT JOIN runs r ON r.doc_id = d.doc_id""",
    "op5_exact_dedup": f"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '{BLANK}', '', 'g') AS n
            FROM documents),
        g AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(x) DESC, doc_id) AS keep_id,
                count(*) OVER (PARTITION BY n) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM g""",
    "op6_ngram_join": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (
            SELECT doc_id, hash(g) AS g FROM (
                SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                    ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS g FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY ALL),
        e AS (
            SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
            WHERE 100 * c >= 85 * (a.n + b.n - c)),
        r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
        LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON m.x = d.doc_id""",
    "op8_substring_dedup": """
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        v AS (
            SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (
                SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
        later AS (SELECT doc_id, i FROM v QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
        gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, (SELECT unnest(range(0, 20)) AS k)),
        words AS (
            SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
        k AS (
            SELECT a.doc_id, count(*) FILTER (WHERE g.i IS NOT NULL) AS n_removed,
                string_agg(x, ' ' ORDER BY a.i) FILTER (WHERE g.i IS NULL) AS kept
            FROM words a LEFT JOIN gone g ON g.doc_id = a.doc_id AND g.i = a.i GROUP BY a.doc_id)
        SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
            sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN k ON k.doc_id = w.doc_id""",
    "op9_decontamination": """
        WITH low AS (
            SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
        w AS (
            SELECT side, id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM low),
        items AS (
            SELECT id AS item_id, len(w) AS n, w, least(13, len(w)) AS k FROM w WHERE side = 'b' AND len(w) > 0),
        windows AS (
            SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
                SELECT item_id, k, w, unnest(range(1, n - k + 2)) AS i FROM items)),
        sizes AS (SELECT DISTINCT k FROM windows),
        runs AS (
            SELECT id AS doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
                SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, sizes WHERE side = 'd' AND len(w) >= k)),
        hits AS (SELECT doc_id, r.k, i, item_id FROM runs r JOIN windows v ON v.k = r.k AND v.g = r.g),
        words AS (
            SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (
                SELECT doc_id, i, unnest(range(0, k)) AS j FROM hits) GROUP BY doc_id),
        names AS (
            SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (
                SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
        SELECT w.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
            coalesce(n_items, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256,
            coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated
        FROM w LEFT JOIN words ON words.doc_id = w.id LEFT JOIN names ON names.doc_id = w.id WHERE side = 'd'""",
}
