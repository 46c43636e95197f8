import time

from pyspark.sql import functions as F

from medialib.session import FREE_SHUFFLES, settle


def shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = disk.getAllFiles()
    return {f for i in range(files.size()) if (f := files.apply(i).getName()).startswith("shuffle_")}


def test_a_written_step_leaves_no_shuffle_files(spark):
    before, had = shuffle_files(spark), spark.conf.get(FREE_SHUFFLES, None)
    rows = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count()
    kept = settle(rows, "counts")
    assert spark.conf.get(FREE_SHUFFLES, None) == had
    assert {(r["k"], r["count"]) for r in kept.collect()} == {(k, 8 if k < 100 else 7) for k in range(700)}
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    # A frame used after a step still has its own shuffles.
    assert rows.count() == 700 and len(rows.collect()) == 700
