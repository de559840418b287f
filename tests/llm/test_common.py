import time

from pyspark.sql import functions as F

from acreline.llm import common


def shuffle_files(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    names = env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {n for n in names if "/shuffle_" in n and n.endswith(".data")}


def test_shuffle_files_go_once_their_query_is_stored(spark):
    before = shuffle_files(spark)
    kept = common.stored(spark.range(3000).groupBy((F.col("id") % 50).alias("k")).agg(F.count("*").alias("n")))
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(common._CLEANUP) == "false"
    assert kept.count() == 50 and kept.agg(F.sum("n")).first()[0] == 3000
