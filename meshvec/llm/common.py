"""Helpers that the operators of this package share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one in spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own; a cluster must
    name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder, for tables with texts or sets: it is compressed and read by column."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def emptied(table: DataFrame) -> None:
    """Give the disk of a settled table back, by writing an empty one over it."""
    path = os.path.dirname(table.inputFiles()[0]) if table.inputFiles() else None
    if path:
        table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Frames made inside drop their shuffle files as soon as an action on them ends. Each of them must be run once only, so end them in cut or settle."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hash_unit(*parts: Column | str) -> Column:
    """A uniform double in [0, 1) of the parts' text: 52 bits of their md5, so other engines can repeat it."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
