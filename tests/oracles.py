"""Every query against its oracle: python tests/oracles.py [sf dir] [name ...]"""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

import compare  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__  # noqa: E402


def main(sf_dir: str, *names: str) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    db, found, sql = compare.connect(sf_dir), __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name in names or found:
        began = time.time()
        what = compare.differences(found[name](spark, sf_dir), db, sql[name]) if name in sql else f"rows only: {found[name](spark, sf_dir).count()}"
        print(f"{name}: {what or 'equal'} ({time.time() - began:.1f} s)", flush=True)


if __name__ == "__main__":
    main(*(sys.argv[1:] or ["/root/testdata/sf0.001"]))
