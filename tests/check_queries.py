"""Run queries against their SQL: `python -m tests.check_queries [dir] [names..]`."""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

from acreline.queries import REGISTRY
from tests.compare import connect, differences


def main(sf_dir="/root/testdata/sf0.01", *names):
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in names or REGISTRY:
        q = REGISTRY[name]
        start = time.time()
        try:
            df = q(spark, sf_dir)
            if q.sql is None:
                n = df.count()
                problems = [] if n else ["no rows"]
            else:
                problems = differences(df, con, q.sql)
        except Exception as e:  # report and go on
            problems = [f"{type(e).__name__}: {str(e)[:700]}"]
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name} {time.time() - start:.1f}s", *problems, flush=True)
    print(f"{bad} of {len(names or REGISTRY)} queries differ")


if __name__ == "__main__":
    main(*sys.argv[1:])
