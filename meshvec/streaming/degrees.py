"""Degrees that follow a stream of edges. An extension: the static graph algorithms have no streaming form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_degrees(edges: DataFrame) -> DataFrame:
    """node, deg over all edges seen so far, for an update or complete output mode. edges: a stream with src, dst."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
