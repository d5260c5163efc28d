"""Side-by-side run of registered queries in Spark and DuckDB."""

import datetime as dt
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 1e15 else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([plain(r[i]) for i in order]) for r in rows)), [columns[i] for i in order]


def compare(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got, got_cols = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want, want_cols = canon(cols, cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        only_got = sorted(set(got) - set(want))[:2]
        only_want = sorted(set(want) - set(got))[:2]
        return f"rows {len(got)} vs {len(want)}; only spark {only_got}; only sql {only_want}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as e
    from sentrank.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    only = sys.argv[2:] or None
    d = f"/root/testdata/sf{sf}"
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(d)
    oracles = e.oracle_sql()
    bad = 0
    for n, q in e.queries().items():
        if only and not any(n.startswith(o) for o in only):
            continue
        t0 = time.time()
        try:
            if n in oracles:
                res = compare(spark, con, n, q, oracles[n], d)
            else:
                res = f"rows-only: {q(spark, d).count()}"
        except Exception as ex:  # noqa: BLE001
            res = f"{type(ex).__name__}: {str(ex)[:600]}"
        bad += res is not None and not str(res).startswith("rows-only")
        print(f"{'ok  ' if res is None else 'DIFF' if not str(res).startswith('rows-only') else 'rows'} {n} {time.time() - t0:.2f}s {res or ''}", flush=True)
    missing = set(oracles) - set(e.queries())
    print("bad", bad, "oracle without query", missing)
