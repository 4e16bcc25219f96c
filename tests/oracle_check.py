"""Run registered queries against their oracle SQL: python tests/oracle_check.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _canon(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return repr(0.0 if value == 0 else value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def canon_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_canon(r[i]) for i in order) for r in rows], key=str)


LOOPS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def pair_loops(df) -> list[str]:
    """Operators of the plan that meet every row of one side with every row of the other."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [name for name in LOOPS if name in plan]


def watch_writes(found: list) -> None:
    """Looks at the plans of intermediate tables as well, when they are written."""
    from pyspark.sql import DataFrameWriter

    plain = DataFrameWriter.parquet

    def parquet(self, *args, **kwargs):
        found.extend(pair_loops(self._df))
        return plain(self, *args, **kwargs)

    DataFrameWriter.parquet = parquet


def compare(spark, con, name, query, sql, sf_dir):
    t0 = time.time()
    df = query(spark, sf_dir)
    got_cols = df.columns
    got = canon_rows([tuple(r) for r in df.collect()], got_cols)
    t1 = time.time()
    if sql is None:
        return "rows-only", len(got), None, t1 - t0, 0.0, None
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = canon_rows(cur.fetchall(), want_cols)
    t2 = time.time()
    if sorted(got_cols) != sorted(want_cols):
        return "COLUMNS", len(got), len(want), t1 - t0, t2 - t1, (sorted(got_cols), sorted(want_cols))
    if got == want:
        return "ok", len(got), len(want), t1 - t0, t2 - t1, None
    a, b = set(got), set(want)
    return "DIFF", len(got), len(want), t1 - t0, t2 - t1, (sorted(got_cols), list(a - b)[:4], list(b - a)[:4])


if __name__ == "__main__":
    import __spark_entry__ as entry
    from offerloom.session import build_session

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf = args.pop(0)
    spark = build_session("oracle-check", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad, loops = [], []
    watch_writes(loops)
    for name in args or queries:
        loops.clear()
        query = queries[name]

        def watched(session, path, query=query):
            df = query(session, path)
            loops.extend(pair_loops(df))
            return df

        try:
            res = compare(spark, con, name, watched, sqls.get(name), sf)
        except Exception as exc:  # report and go on with the next query
            res = ("ERROR", None, None, 0.0, 0.0, str(exc)[:1500])
        print(f"{name:28s} {res[0]:9s} rows={res[1]} oracle={res[2]} spark={res[3]:.1f}s duck={res[4]:.1f}s", flush=True)
        if loops:
            print("     PAIR LOOP", sorted(set(loops)), flush=True)
        if res[0] not in ("ok", "rows-only"):
            bad.append(name)
            print("    ", str(res[5])[:1800], flush=True)
        elif res[1] == 0:
            print("     EMPTY RESULT", flush=True)
    print("bad:", bad)
