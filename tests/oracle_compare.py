"""Compare every query with its SQL: ``python tests/oracle_compare.py SF_DIR [NAME...]``."""

from __future__ import annotations

import math
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings papers source_records pairs screenings collections arxiv_fields pubmed_fields benchmark_items".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 5)
    if hasattr(value, "to_eng_string"):
        return round(float(value), 5)
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    got = query(spark, sf_dir)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    a, b = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(names, want.fetchall())
    if a == b:
        return None
    only_a, only_b = [r for r in a if r not in b][:2], [r for r in b if r not in a][:2]
    return f"{len(a)} and {len(b)} rows; only Spark {only_a}; only SQL {only_b}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from paperloom.session import build_session

    spark = build_session(cpus=8)
    spark.sparkContext.setLogLevel("OFF")
    con, queries, sqls = connect(sys.argv[1]), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or sqls:
        try:
            why = difference(spark, con, queries[name], sqls[name], sys.argv[1])
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:300]}"
        if why:
            bad += 1
            print(name, why[:700])
    print(len(sqls), "compared,", bad, "differ")
