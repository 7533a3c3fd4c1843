"""Runs queries on Spark and their SQL in DuckDB and compares the rows.

    python -m checks.compare /root/testdata/sf0.01 [name-prefix ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{os.path.join(sf, name)}.parquet')")
    return con


def _plain(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return f"b{int(value)}"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.isoformat(timespec="microseconds")
    return str(value)


def _kind(value):
    return type(value).__name__


def compare(con, df, sql):
    """Return a text about the first difference, or None."""
    rows = [tuple(r) for r in df.collect()]
    names = df.columns
    cursor = con.execute(sql)
    other_names = [d[0] for d in cursor.description]
    other = cursor.fetchall()
    if sorted(names) != sorted(other_names):
        return f"columns {sorted(set(names) ^ set(other_names))} differ"
    if len(rows) != len(other):
        return f"{len(rows)} rows against {len(other)}"
    places = [names.index(c) for c in sorted(names)]
    other_places = [other_names.index(c) for c in sorted(names)]
    for i, c in enumerate(sorted(names)):
        kinds = {_kind(r[places[i]]) for r in rows[:500]} - {"NoneType"}
        others = {_kind(r[other_places[i]]) for r in other[:500]} - {"NoneType"}
        if kinds and others and kinds != others:
            return f"column {c}: types {kinds} against {others}"
    mine = sorted(tuple(_plain(r[i]) for i in places) for r in rows)
    theirs = sorted(tuple(_plain(r[i]) for i in other_places) for r in other)
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{sorted(names)}: {a} against {b}"
    return None


def main(argv):
    from checks import all_checks
    from editwarden.session import build_session
    sf, prefixes = argv[0], argv[1:]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                              "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = all_checks()
    con = connect(sf)
    failed = 0
    for name, query in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = query(spark, sf)
            if name in sqls:
                problem = compare(con, df, sqls[name])
            else:
                n = len(df.collect())
                problem = None if n else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:34s} {time.time() - start:6.1f}s {'ok' if problem is None else 'DIFFERS ' + problem}"
              f"{'' if name in sqls else ' (rows only)'}", flush=True)
    print(f"{failed} of the queries differ")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
