"""The pipeline, stage by stage, against plain versions of its decisions."""

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from sentrank.llm.common import table

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    bench = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after.items() <= before.items()
        rows = sorted(before.items())
        if name == "language_id":
            assert {k for k, v in rows if not any(c.isalpha() for c in v or "")} <= before.keys() - after.keys()
            assert len(after) >= 0.97 * len(before)
        elif name == "exact_dedup":
            assert set(after) == {r[0] for r in brute.exact(rows) if r[3]}
        elif name == "ngram_join":
            assert set(after) == {r[2] for r in brute.components(rows, 5, 80)}
        else:
            assert set(after) == {r[0] for r in brute.decontaminate(rows, bench) if not r[5]}
    from .test_tokens import ids
    pieces = [tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()]
    assert brute.check_pieces(pieces, {k: ids(v) + [1] for k, v in after.items()}) == 0


def test_run_is_the_stages_in_order(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.where("start = 0").count() > 100


def odd_documents(spark):
    """Null, empty, blank, repeated and very long texts, missing and shared ids, and columns of awkward names."""
    plain = table(spark, SF, "documents").limit(60).select("doc_id", "text", "lang")
    rows = [(None, None, None), (None, "", None), (9001, " \n", None), (9002, "x" * 50_000, "en"), (9003, "1234 !?", "en"),
            (9004, "the same words again and again", "en"), (9004, "the same words again and again", "en"),
            (None, "the same words again and again", "en"), (9005, "the same  words again and again", None)]
    some = plain.union(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    for name in ("source", "score", "kept", "a.b", "block"):
        some = some.withColumn(name, F.lit("x"))
    return some


def test_stages_take_odd_rows(spark):
    docs = odd_documents(spark)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:20]) for r in df.select("doc_id", "text").collect())
    every = ids(docs)
    stages = [stage(spark, docs, SF) for _, stage in corpus_pipeline.STAGES[:-1]]
    assert all(left.columns == docs.columns for left in stages)
    known, exact, near, clean = map(ids, stages)        # each stage runs once
    for left in (known, exact, near, clean):
        assert all(left.count(x) <= every.count(x) for x in left)
    assert not [x for x in known if not any(c.isalpha() for c in x[2])]
    assert [x[1:] for x in exact if "same" in x[2]] == [(9005, "the same  words agai")]        # the longest original
    assert sum(not x[2].strip() for x in exact) == 1
    assert {x[1] for x in near if x[2].startswith("the same")} == {9004}
    assert sum(not x[2].strip() for x in near) == 3
    assert sum(x[2].startswith("the same") for x in clean) == 4
    pieces = corpus_pipeline.packed(spark, docs, SF)
    assert pieces.where("start = 0").count() == len(every)


def test_stages_take_an_empty_table(spark):
    docs = odd_documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
