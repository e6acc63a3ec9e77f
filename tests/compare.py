"""Runs registered queries and their SQL twins on the same tables and compares rows."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows), key=repr
    )


def database(sf_dir):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        db.execute(f"create view {name} as select * from '{path}'")
    return db


def compare(spark, name, run, sql, sf_dir, db):
    got_df = run(spark, sf_dir)
    got = normal(got_df.columns, [tuple(r) for r in got_df.collect()])
    if sql is None:
        return None if got[1] else "no rows"
    cursor = db.execute(sql)
    want = normal([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        extra = [r for r in got[1] if r not in want[1]][:2]
        lacking = [r for r in want[1] if r not in got[1]][:2]
        return f"{len(got[1])} rows vs {len(want[1])}; only here {extra}; only there {lacking}"
    return None if got[1] else "no rows"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pagequarry.session import local_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark, db = local_session(8), database(sf_dir)
    oracles = entry.oracle_sql()
    for name, run in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, name, run, oracles.get(name), sf_dir, db)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        kind = "sql" if name in oracles else "rows"
        print(f"{'ok ' if problem is None else 'BAD'} {name} [{kind}] {time.time() - start:.1f}s {problem or ''}", flush=True)
