"""Run registered queries and their SQL side by side: python tests/compare.py [sf_dir] [names]."""

import os
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    values = frame.astype(object).where(frame.notna(), None).astype(str)
    return sorted(map(tuple, values.itertuples(index=False)))


def difference(spark, query, sql: str, sf_dir: str) -> str | None:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {name} as select * from '{path}'")
    want = con.sql(sql).df()
    got = query(spark, sf_dir).toPandas()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in got.columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1]}
    left, right = rows_of(got), rows_of(want)
    if left != right:
        extra = [r for r in left if r not in set(right)][:2]
        lost = [r for r in right if r not in set(left)][:2]
        return f"{len(left)} and {len(right)} rows\n  only query: {extra}\n  only SQL: {lost}"
    if odd:
        return f"types {odd}"
    return None


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from mailframe.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            problem = difference(spark, queries[name], sql[name], sf_dir) if name in sql else "no SQL"
        except Exception as failure:  # noqa: BLE001
            problem = str(failure)[:1500]
        bad += problem is not None
        print(f"{name}: {problem or 'equal'} ({time.time() - start:.1f}s)", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())
