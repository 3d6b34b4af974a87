"""Command line: python tests/run_oracles.py <folder> [name prefix ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from slatewise.session import local_session  # noqa: E402

if __name__ == "__main__":
    folder, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = local_session(8, **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    oracles, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            df.write.format("noop").mode("overwrite").save()
            spent = time.time() - start
            if name in oracles:
                problem = compare(df, db, oracles[name])
            else:
                problem, rows = None, df.count()
                print(f"   rows only: {rows}")
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
            spent = -1
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {spent:.2f}s {problem or ''}", flush=True)
    print("failed:", failed)
