"""Edge tables: cleaning, symmetry, and splitting among parties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshvec.functions.columns import mix_key, tile
from meshvec.functions.lineage import global_rank


def canonical(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, smaller end first; self-loops stay."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def symmetrize(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse, so a self-loop comes twice. Other columns go along."""
    return edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def self_loops(edges: DataFrame) -> DataFrame:
    """node, n: self-loops and how often each is listed."""
    return edges.filter("src = dst").groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"))


def split_parties(edges: DataFrame, parties: int, *, shuffle_key: Column | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """edges with party 1..parties: lines in a mixed order are cut into near-equal runs, the first ones taking the rest.

    The order is a key of the two ids (or shuffle_key), then the ids, then the
    tie columns, so a split is a function of the lines alone.
    """
    keyed = edges.withColumn("__key", mix_key(F.col("src"), F.col("dst")) if shuffle_key is None else shuffle_key)
    ranked = global_rank(keyed, ["__key", "src", "dst", *ties], "__rank")
    return ranked.withColumn("party", tile(F.col("__rank"), F.col("n"), parties)).drop("__key", "__rank", "n")


def split_undirected(lines: DataFrame, parties: int) -> DataFrame:
    """src, dst, party of an undirected list: canonical edges are split, then each party gets its edges both ways."""
    return symmetrize(split_parties(canonical(lines), parties))


def party_edges(split: DataFrame) -> DataFrame:
    """What each party holds: its edges without repeats, weight 1."""
    return split.select("src", "dst", "party").distinct().withColumn("w", F.lit(1.0))


def merge_parties(held: DataFrame) -> DataFrame:
    """src, dst, w over all parties: an edge that two parties hold weighs 2."""
    return held.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def isolated(edges: DataFrame, universe: DataFrame) -> DataFrame:
    """Nodes of the universe that no edge has."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return universe.select("node").join(ends, "node", "left_anti")


def pad_nodes(values: DataFrame, universe: DataFrame, column: str) -> DataFrame:
    """values (node, column) with 0 for nodes of the universe that lack one."""
    return universe.select("node").join(values, "node", "left").select("node", F.coalesce(column, F.lit(0.0)).alias(column))
