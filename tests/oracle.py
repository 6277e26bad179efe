"""Run registered queries next to their SQL counterparts and compare all values.

Usage: python tests/oracle.py [sf_dir] [query ...]
"""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> list[str]:
    """Rows as sorted text with columns in name order; floats to 9 significant digits."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, float):
            return f"{v:.9g}"
        if hasattr(v, "as_tuple"):
            return f"{float(v):.9g}"
        if isinstance(v, int):
            return f"{float(v):.9g}" if abs(v) < 10**9 else str(v)
        if hasattr(v, "isoformat"):
            return v.isoformat()
        return str(v)

    return sorted("\x1f".join(text(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, name: str, query, sql: str | None) -> tuple[bool, str]:
    began = time.time()
    df = query(spark, sf_dir)
    got = [tuple(row) for row in df.collect()]
    took = time.time() - began
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {took:.1f} s"
    began = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    note = f"{len(got)}/{len(want)} rows, {took:.1f} s, SQL {time.time() - began:.1f} s"
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}; {note}"
    left, right = canonical(df.columns, got), canonical(names, want)
    if left != right:
        only = sorted(set(left) - set(right))[:3], sorted(set(right) - set(left))[:3]
        return False, f"{note}\n   spark only {only[0]}\n   sql only   {only[1]}"
    return True, note


def main() -> int:
    import __spark_entry__ as entry
    from echolens.session import build_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("oracle", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        try:
            ok, note = compare(spark, con, sf_dir, name, query, sql.get(name))
        except Exception as error:
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {note}", flush=True)
    unknown = set(sql) - set(entry.queries())
    print("unknown sql keys:", unknown, "failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
