import os

from pyspark.sql import functions as F

from inkstone.session import clear_scratch, scratch_path, shared_dir, spread, spread_again, written


def test_written_tables_and_their_removal(spark):
    clear_scratch(spark)
    df = written(spark.range(10).withColumn("x", F.lit("a")), "some")
    assert df.count() == 10 and len(df.inputFiles()) > 0 and shared_dir(spark) in scratch_path(spark, "other")
    assert clear_scratch(spark) == 2 and not os.path.exists(df.inputFiles()[0].removeprefix("file://"))


def test_spreading(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert spread(df, "id").rdd.getNumPartitions() == 8 and spread(spark.range(100, numPartitions=20), "id").rdd.getNumPartitions() == 20
    assert spread_again(df.groupBy("id").count(), df, "id").rdd.getNumPartitions() == 8
