"""Dense numbers in a given order, without gathering a group in one task."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """df from the shared checkpoint folder; a folder of our own only in local mode, where none is set."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix=f"tagmill-{os.getpid()}-"))
    return df.checkpoint(eager=True)


def dense_numbers(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df with 1, 2, ... in `order` within each group.

    Rows are range-partitioned by group and order, so a group of any size spreads over partitions. Each partition
    numbers its own rows; the counts (one row a group and partition) are summed up and added.
    """
    parts = cut_lineage(df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy(group, "_part").count()
    before = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_q"), (F.sum("count").over(Window.partitionBy(group).orderBy("_part")) - F.col("count")).alias("_before"))
    local = parts.withColumn("_n", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)))
    joined = local.join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_q")))
    return joined.withColumn(name, (F.col("_n") + F.col("_before")).cast("long")).drop("_part", "_n", "_g", "_q", "_before")


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
