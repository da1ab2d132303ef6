"""Compare registered queries with their SQL in DuckDB: python tests/oracle.py [sf_dir] [name part ...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9) if math.isfinite(value) else str(value)
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat() if hasattr(value, "tzinfo") else value.isoformat()
    return value


def compare(spark, con, sf_dir, query, sql):
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != columns:
        return f"columns {columns} vs {sorted(names)}"
    place = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in place) for r in cur.fetchall()), key=repr)
    if got == want:
        return None if got else "no rows"
    both = set(got) & set(want)
    return f"rows {len(got)} vs {len(want)}; only spark {[r for r in got if r not in both][:2]}; only sql {[r for r in want if r not in both][:2]}"


def main():
    import __spark_entry__ as entry
    from edgeloom.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    parts = sys.argv[2:]
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in sql:
                note = compare(spark, con, sf_dir, query, sql[name])
                note = "equal" if note is None else f"DIFFERENT {note}"
            else:
                note = f"rows only: {query(spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            note = f"DIFFERENT {type(error).__name__}: {str(error)[:1500]}"
        bad += note.startswith("DIFFERENT")
        print(f"{name:40s} {time.time() - start:6.1f}s {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
