"""python tests/run_compare.py FOLDER [name ...] : compare queries with their SQL twins."""

import sys
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

from compare import connection, differences
from pyspark.sql import SparkSession

import __spark_entry__ as entry
from tallyframe.session import owned

spark = (
    SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
    .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
folder, names = sys.argv[1], sys.argv[2:]
con, sql = connection(folder), entry.oracle_sql()
bad = 0
for name, run in entry.queries().items():
    if names and name not in names:
        continue
    start = time.time()
    try:
        with owned(spark):
            df = run(spark, folder)
            found = differences(df, con, sql[name]) if name in sql else [] if df.count() >= 0 else []
    except Exception as error:
        found = ["".join(traceback.format_exception_only(error))[:1500]]
    print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.2f}s", *found, sep="\n     " if found else " ", flush=True)
    bad += bool(found)
print("queries", len(entry.queries()), "failed", bad)
