"""Run registered queries against DuckDB: ``python tools/check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import pathlib
import sys
import time
import traceback

sys.path[:0] = [str(pathlib.Path(__file__).resolve().parents[1])]

from tests.oracle import compare, duck
from tracewell.catalog import all_queries, all_sql
from tracewell.session import get_spark


def main() -> None:
    sf_dir = sys.argv[1]
    names = sys.argv[2:]
    spark = get_spark("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sql = all_sql()
    for name, fn in all_queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sql:
                ok, note = compare(con, df, sql[name])
            else:
                ok, note = True, f"{df.count()} rows, no SQL"
        except Exception as exc:  # report and continue with the next query
            ok, note = False, str(exc)[:700] + " ... " + "".join(traceback.format_exception(exc))[-300:]
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - t0:6.2f}s {note}", flush=True)


if __name__ == "__main__":
    main()
