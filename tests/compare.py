"""Run every registered query beside its SQL: python tests/compare.py <sf_dir> [name...]"""

import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/", 2)[0])
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(root):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None if both hold the same rows in any order."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    columns = sorted(got.columns)

    def lines(df):
        df = df[columns]
        out = []
        for row in df.itertuples(index=False, name=None):
            out.append(tuple("NULL" if pd.isna(v) else (repr(float(v)) if isinstance(v, float) else str(v)) for v in row))
        return sorted(out)

    for a, b in zip(lines(got), lines(want)):
        if a != b:
            return f"{columns}: {a} vs {b}"
    kinds = lambda df: {c: ("f" if df[c].dtype.kind == "f" else "i" if df[c].dtype.kind in "iu" else "o") for c in columns if not df[c].isna().all()}
    if kinds(got) != kinds(want):
        return f"types {kinds(got)} vs {kinds(want)}"
    return None


def main():
    from __spark_entry__ import oracle_sql, queries
    from rarespark.session import local_session

    root, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8, "compare")
    con, failed = duck(root), []
    statements = oracle_sql()
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = query(spark, root).toPandas()
            took = time.time() - start
            if name in statements:
                start = time.time()
                want = con.execute(statements[name]).df()
                sql_took = time.time() - start
                problem = difference(got, want)
                note = "same" if problem is None else "DIFFERENT " + problem
                note += f" (sql {sql_took:.1f}s)"
            else:
                problem, note = (None, "rows only") if len(got) else ("empty", "EMPTY")
        except Exception as error:  # noqa: BLE001
            problem, note, took, got = "error", "ERROR " + str(error)[:600], time.time() - start, []
        if problem:
            failed.append(name)
        print(f"{name:26s} {took:6.1f}s {len(got):7d} rows  {note}", flush=True)
        spark.catalog.clearCache()
    print("failed:", failed)
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
