import gzip

import pytest
from pyspark.sql import functions as F

from sentrank.functions import numbers, times
from sentrank.operators import canonical, quality, split
from sentrank.plans import workflows
from sentrank.sources import csv_scan
from sentrank.sources import tables as source


def write(folder, name, text):
    path = folder / name
    if name.endswith(".gz"):
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)
    return str(path)


def test_union_of_differing_headers(spark, tmp_path):
    write(tmp_path, "a.csv", "id,a.x,b\n1,x1,b1\n2,x2,b2\n")
    write(tmp_path, "b.csv.gz", "b,id\nb3,3\n")
    files = csv_scan.find_files(spark, str(tmp_path))
    assert len(files) == 2
    df = csv_scan.scan_union(spark, files)
    assert df.columns == ["a.x", "b", "id"]
    rows = {r["id"]: (r["a.x"], r["b"]) for r in df.collect()}
    assert rows == {"1": ("x1", "b1"), "2": ("x2", "b2"), "3": (None, "b3")}


def test_bad_lines_na_tokens_and_line_breaks(spark, tmp_path):
    write(tmp_path, "a.csv", 'id,a,b\n1,x\n2,x,y,z\n3,x,y,\n4,NA,"q ""w"""\n5,"two\nlines",k\n6,,null\n')
    rows = {r["id"]: (r["a"], r["b"]) for r in csv_scan.scan_union(
        spark, csv_scan.find_files(spark, str(tmp_path))).collect()}
    assert rows == {"1": ("x", None), "4": (None, 'q "w"'), "5": ("two\nlines", "k"), "6": (None, None)}


def test_long_lines_of_every_kind(spark, tmp_path):
    """Extra fields, empty or not, drop a line; separators inside quotes do not count."""
    write(tmp_path, "a.csv", 'id,a\n1,x\n2,x,,\n3,x,,y\n4,x,y\n5,"x,,,y"\n6,"a ""b"", c"\n7,"q,",,z\n8\n9,x,\n')
    got = {r["id"]: r["a"] for r in csv_scan.scan_union(spark, csv_scan.find_files(spark, str(tmp_path))).collect()}
    assert got == {"1": "x", "5": "x,,,y", "6": 'a "b", c', "8": None}


def test_headers_in_one_job(spark, tmp_path):
    """The number of jobs does not depend on the number of files."""
    for i in range(30):
        write(tmp_path, f"f{i:02d}.csv", f"id,{'a' if i % 2 else 'b'}\n{i},x\n" if i != 7 else 'id,"a,1"\n7,x\n')
    files = csv_scan.find_files(spark, str(tmp_path))
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        groups = csv_scan.scan_groups(spark, files)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers")) < 12
    assert sorted(g.columns for g in groups) == [["id", "a"], ["id", "a,1"], ["id", "b"]]
    assert sum(g.count() for g in groups) == 30


def test_five_smallest_examples(spark):
    rows = spark.range(5000).select(F.format_string("%04d", F.col("id") % 3000).alias("x"), F.lit(None).cast("string").alias("none"),
                                    F.when(F.col("id") % 2 == 0, F.repeat(F.lit("y"), 500)).alias("long"), (F.col("id") % 2).alias("two"))
    got = {r["column"]: r["examples"] for r in quality.coverage_report(rows.repartition(7)).collect()}
    assert got == {"x": "0000; 0001; 0002; 0003; 0004", "none": "", "long": "y" * 120, "two": "0; 1"}


def test_no_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        csv_scan.find_files(spark, str(tmp_path))


def test_time_parsing(spark):
    texts = ["Aug 12, 2025 @ 16:03:14.261", "Aug 12, 2025 @ 16:03:14", "Aug 2, 2025 @ 6:03:14.5",
             "2025-08-12T16:03:14", "2025-08-12 16:03:14.25", "garbage", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(times.parse_export_time(F.col("t")).cast("string"), times.parse_any_time(F.col("t")).cast("string"),
                    times.parse_export_time(F.col("t"), strict=True).cast("string")).collect()
    assert [r[0] for r in got] == ["2025-08-12 16:03:14.261", "2025-08-12 16:03:14", "2025-08-02 06:03:14.5",
                                   None, None, None, None]
    assert [r[1] for r in got][3:] == ["2025-08-12 16:03:14", "2025-08-12 16:03:14.25", None, None]
    assert got[1][2] is None and got[0][2] == "2025-08-12 16:03:14.261"
    assert df.select(times.format_export_time(times.parse_export_time(F.col("t")))).collect()[2][0] == \
        "Aug 02, 2025 @ 06:03:14.500"


def test_level_coercion(spark):
    df = spark.createDataFrame([(t,) for t in ["5", "5.0", " 5 ", "5.7", "x", None]], "t string")
    assert [r[0] for r in df.select(numbers.to_level(F.col("t"))).collect()] == [5, 5, 5, None, None, None]


def test_mapping_rules():
    cols = ["_id", "_source.timestamp", "_source.agent.id", "_source.rule.id", "_source.rule.level", "decoder"]
    m = canonical.clean_mapping(cols)
    assert m["agent"] == "_source.agent.id" and m["event_id"] == "_id" and m["decoder"] == "decoder"
    assert canonical.clean_mapping([*cols, "agent.name"])["agent"] == "agent.name"
    with pytest.raises(ValueError, match="rule_id"):
        canonical.clean_mapping([c for c in cols if c != "_source.rule.id"])
    assert canonical.service_mapping([*cols, "timestamp"])["timestamp"] == "timestamp"
    assert canonical.dropped_columns([*cols, "z"], m) == ["z"]


def test_dedup_keeps_first_and_one_null(spark, alert_rows):
    df = alert_rows([
        ("1", "2024-01-02", "a", "r", 1, "d"), ("1", "2024-01-01", "a", "r2", 2, "d"), ("1", None, "a", "r", 3, "d"),
        (None, "2024-01-03", "a", "x", 1, "d"), (None, "2024-01-02", "a", "y", 1, "d"),
    ])
    got = {r["event_id"]: (r["rule_id"], r["rule_level"]) for r in canonical.dedup_keep_first(df).collect()}
    assert got == {"1": ("r2", 2), None: ("y", 1)}


def test_sort_puts_missing_time_last(spark, alert_rows):
    df = alert_rows([("1", None, "a", "r", 1, "d"), ("2", "2024-01-02", "a", "r", 1, "d"),
                     ("3", "2024-01-01", "a", "r", 1, "d")])
    assert [r["event_id"] for r in canonical.sort_by_time(df, "timestamp").collect()] == ["3", "2", "1"]


def test_split_bounds_and_gap(spark, alert_rows):
    df = alert_rows([(str(i), t, "a", "r", 1, "d") for i, t in enumerate(
        ["2024-01-01 23:59:59", "2024-01-02", "2024-01-03", "2024-01-04 23:59:59.999", "2024-01-05", None])])
    got = {r["event_id"]: r["split"] for r in split.temporal_split(df, "2024-01-01", "2024-01-03", "2024-01-04").collect()}
    assert got == {"0": "T1", "2": "T2", "3": "T2", "4": "T3"}
    for which, ids in (("T1", {"0"}), ("T2", {"2", "3"}), ("T3", {"4"})):
        rows = split.window_rows(df, which, "2024-01-01", "2024-01-03", "2024-01-04").collect()
        assert {r["event_id"] for r in rows} == ids
    with pytest.raises(ValueError):
        split.check_bounds("2024-01-03", "2024-01-03", "2024-01-04")


def test_coverage_denominators(spark):
    a = spark.createDataFrame([("1", "x"), ("2", None)], "id string, a string")
    b = spark.createDataFrame([("3",), ("4",)], "id string")
    present = {r["column"]: (r["non_null"], r["total"], r["coverage"])
               for r in quality.coverage_report([a, b], "present").collect()}
    whole = {r["column"]: r["coverage"] for r in quality.coverage_report([a, b]).collect()}
    assert present == {"id": (4, 4, 1.0), "a": (1, 2, 0.5)}
    assert whole == {"id": 1.0, "a": 0.25}


def test_sample_size_and_repeatability(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("event_id"))
    one = {r[0] for r in quality.uniform_sample(df, 700).collect()}
    two = {r[0] for r in quality.uniform_sample(df.repartition(13), 700).collect()}
    assert len(one) == 700 and one == two
    assert one != {r[0] for r in quality.uniform_sample(df, 700, seed=1).collect()}
    assert quality.uniform_sample(df, 9999).count() == 5000


def test_workflow_from_csv_to_split(spark, tmp_path):
    head = "_id,_source.@timestamp,_source.timestamp,_source.agent.name,_source.rule.id,_source.rule.level,_source.decoder.name"
    lines = [f'e{i},"Aug {1 + i % 20}, 2025 @ 1{i % 10}:00:00.000","Aug {1 + i % 20}, 2025 @ 1{i % 10}:00:00.000",h{i % 3},r{i % 4},{i % 9},'
             for i in range(60)]
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "a.csv", "\n".join([head, *lines, lines[0]]) + "\n")
    write(tmp_path / "in", "b.csv", "_id,extra\nz,1\n")
    merged = workflows.merge(spark, str(tmp_path / "in"), str(tmp_path / "merged"), dedupe=True, csv=True)
    assert merged.columns[0] == "_source.@timestamp" and merged.count() == 61
    prof = workflows.profile(spark, str(tmp_path / "in"), str(tmp_path / "prof"), min_pct=0.9, sample=10)
    assert prof["reduced"].columns == ["_source.@timestamp", "_id", "_source.agent.name", "_source.rule.id",
                                       "_source.rule.level", "_source.timestamp"]
    assert prof["sample"].count() == 10
    done = workflows.clean(merged.filter("extra IS NULL"), str(tmp_path / "clean"))
    assert done["alerts"].count() == 60
    facts = {(r["metric"], r["key"]): r["value"] for r in done["report"].collect()}
    assert facts[("null_count", "decoder")] == "60" and facts[("dropped_column", "extra")] == ""
    parts = workflows.split_windows(done["alerts"], str(tmp_path / "split"), "2025-08-10", "2025-08-11", "2025-08-15")
    assert [parts[s].count() for s in ("T1", "T2", "T3")] == [30, 15, 15]
    assert tuple(parts["input_counts"].first()) == (60, 0)
    stats = str(tmp_path / "stats")
    feats = workflows.fit_features(parts["T1"], stats, str(tmp_path / "f1"))
    assert feats.count() == 30
    assert source.read_stats(spark, stats)["globals"].count() == 1
    later = workflows.apply_features(parts["T2"], stats, str(tmp_path / "f2"))
    csv = str(tmp_path / "f2_csv_in")
    later.write.option("header", "true").csv(csv)
    typed = source.read_features_csv(spark, csv)
    assert dict(typed.dtypes)["rule_level_z_host"] == "double" and typed.count() == 15
    assert typed.filter("timestamp IS NULL").count() == 0
