"""Cutting lineage, and ranks over a whole table."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local session without one gets its own."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """df with the 1-based rank of each row in the order of the given columns, and n, the number of rows.

    A window without partitions would put all rows into one task. Here the rows
    are range-partitioned and kept, ranked inside their range, and moved up by
    the size of the ranges before: a table with one row for each range, which
    is why it may be broadcast.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"), F.sum("__size").over(all_of).alias("n"))
    ranked = ranged.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return ranked.join(F.broadcast(offsets), "__part").select(*df.columns, (F.col("__rank") + F.col("__before")).alias(name), "n")
