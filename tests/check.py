"""Run named queries against their SQL: ``python tests/check.py SF_DIR [name …]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402
from threadmine.session import build_session  # noqa: E402


def _tuned():
    return build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                         spark__driver__memory="8g", spark__ui__showConsoleProgress="false")


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    if os.environ.get("CHECK_PLAIN"):  # the settings a driver has that knows nothing of this library
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config(
            "spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        spark = SparkSession.getActiveSession()
    else:
        spark = _tuned()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            result = compare(df, con, sqls[name]) if name in sqls else ("rows only", len(df.collect()))
        except Exception as error:
            result = "".join(traceback.format_exception_only(error))[:1500]
        ok = result == "" or isinstance(result, tuple)
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {result}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
