"""Degrees, volumes, neighbour lists and alias tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshvec.functions.columns import hash_uniform
from meshvec.functions.lineage import cut, global_rank

#: Neighbours that one row of an alias table of two levels holds at most.
CHUNK = 4096


def in_degree(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """node, deg: sums of weights by target, as the column sums of the matrix; by: further keys such as the party."""
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    return edges.groupBy(F.col("dst").alias("node"), *by).agg(F.sum(w).alias("deg"))


def global_degree(by_party: DataFrame) -> DataFrame:
    return by_party.groupBy("node").agg(F.sum("deg").alias("deg"))


def volume(edges: DataFrame, mode: str) -> DataFrame:
    """One row, vol: the sum of weights, the number of different undirected edges, or the number of lines."""
    if mode == "sum_weights":
        return edges.agg(F.coalesce(F.sum(F.col("w") if "w" in edges.columns else F.lit(1.0)), F.lit(0.0)).alias("vol"))
    if mode == "edge_count":
        return edges.select(F.least("src", "dst"), F.greatest("src", "dst")).distinct().agg(F.count(F.lit(1)).cast("double").alias("vol"))
    if mode == "line_count":
        return edges.agg(F.count(F.lit(1)).cast("double").alias("vol"))
    raise ValueError(f"no volume mode {mode}")


def adjacency(edges: DataFrame) -> DataFrame:
    """node, neighbours (sorted array), weights (in the same order). A hub's list is one row, as the walk operators avoid."""
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    pairs = F.array_sort(F.collect_list(F.struct(F.col("dst").alias("n"), w.alias("w"))))
    return edges.groupBy(F.col("src").alias("node")).agg(pairs.alias("p")).select("node", F.transform("p", lambda x: x["n"]).alias("neighbours"), F.transform("p", lambda x: x["w"]).alias("weights"))


def weight_map(edges: DataFrame) -> DataFrame:
    """node, weights: a map from neighbour to weight."""
    return adjacency(edges).select("node", F.map_from_arrays("neighbours", "weights").alias("weights"))


def alias_table(weights: list[float]) -> tuple[list[int], list[float]]:
    """Thresholds q and stand-ins J with which one uniform number draws an index in constant time."""
    k, total = len(weights), sum(weights)
    q = [w * k / total for w in weights]
    stand_in = list(range(k))
    low, high = [i for i in range(k) if q[i] < 1], [i for i in range(k) if q[i] >= 1]
    while low and high:
        a, b = low.pop(), high.pop()
        stand_in[a] = b
        q[b] -= 1 - q[a]
        (low if q[b] < 1 else high).append(b)
    return stand_in, [min(1.0, x) if i not in low else 1.0 for i, x in enumerate(q)]


def alias_tables(adj: DataFrame, by: tuple[str, ...] = ("node",)) -> DataFrame:
    """adj (by, neighbours, weights) with its alias table: stand_in (places in neighbours) and threshold arrays."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tables = [alias_table(list(w)) for w in pdf["weights"]]
            yield pdf.assign(stand_in=[t[0] for t in tables], threshold=[t[1] for t in tables])

    keys = ", ".join(f"{c} long" for c in by)
    return adj.select(*by, "neighbours", "weights").mapInPandas(build, f"{keys}, neighbours array<long>, weights array<double>, stand_in array<int>, threshold array<double>")


def alias_places(tables: DataFrame, by: tuple[str, ...] = ("node",)) -> DataFrame:
    """by, place, neighbour, other, threshold, k: alias tables with a row for each place, so that drawing never handles a list as one row."""
    cells = tables.select(*by, "neighbours", F.size("neighbours").alias("k"), F.posexplode(F.arrays_zip("stand_in", "threshold")).alias("place", "cell"))
    return cells.select(*by, "place", F.get("neighbours", F.col("place")).alias("neighbour"), F.get("neighbours", F.col("cell.stand_in")).alias("other"), F.col("cell.threshold").alias("threshold"), "k")


def alias_draw(rows: DataFrame, places: DataFrame, seed: int = 0, by: tuple[str, ...] = ("node",)) -> DataFrame:
    """rows (by, draw, ...) with `drawn`, a neighbour by its weight: one uniform number picks the place, another the neighbour or its stand-in.

    draw is a key of its own for each row, from which both numbers are hashed.
    A node without neighbours draws null.
    """
    sizes = places.select(*by, "k").distinct()
    asked = rows.join(sizes, list(by), "left").withColumn("place", F.floor(hash_uniform(seed, F.col("draw")) * F.col("k")).cast("int"))
    met = asked.drop("k").join(places.drop("k"), [*by, "place"], "left")
    drawn = F.when(hash_uniform(seed + 1, F.col("draw")) < F.col("threshold"), F.col("neighbour")).otherwise(F.col("other"))
    return met.select(*rows.columns, drawn.alias("drawn"))


def hub_alias_tables(edges: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Alias tables of two levels: (node, chunk, neighbours, weights, stand_in, threshold) of at most `chunk` neighbours each, and for each node a table over its chunks' weights.

    edges: src, dst, w; each pair once. A neighbour's chunk follows from its
    place in one global order, so no list of more than `chunk` neighbours is
    ever a row or a task's. The upper table has a hub's neighbours / chunk
    entries: 244 for a million.
    """
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    ranked = cut(global_rank(edges.select("src", "dst", w.cast("double").alias("w")), ["src", "dst"], "rank").drop("n"))
    first = ranked.groupBy("src").agg(F.min("rank").alias("first"))
    dealt = ranked.join(first, "src").select(F.col("src").alias("node"), F.floor((F.col("rank") - F.col("first")) / chunk).cast("long").alias("chunk"), F.struct(F.col("dst").alias("n"), "w").alias("x"))
    lists = dealt.groupBy("node", "chunk").agg(F.array_sort(F.collect_list("x")).alias("p"))
    lists = lists.select("node", "chunk", F.transform("p", lambda x: x["n"]).alias("neighbours"), F.transform("p", lambda x: x["w"]).alias("weights"))
    low = cut(alias_tables(lists, ("node", "chunk")))
    of_chunk = F.struct(F.col("chunk").alias("n"), F.aggregate("weights", F.lit(0.0), lambda s, x: s + x).alias("w"))
    tops = low.groupBy("node").agg(F.array_sort(F.collect_list(of_chunk)).alias("p"))
    tops = tops.select("node", F.transform("p", lambda x: x["n"]).alias("neighbours"), F.transform("p", lambda x: x["w"]).alias("weights"))
    return low, alias_tables(tops)


def hub_alias_draw(rows: DataFrame, low: DataFrame, top: DataFrame, seed: int = 0) -> DataFrame:
    """rows (node, draw, ...) with `drawn`: the upper table draws a chunk, the chunk's table a neighbour."""
    in_chunk = alias_draw(rows, alias_places(top), seed).withColumnRenamed("drawn", "chunk")
    return alias_draw(in_chunk, alias_places(low, ("node", "chunk")), seed + 2, ("node", "chunk")).drop("chunk")


def hub_alias_probabilities(low: DataFrame, top: DataFrame) -> DataFrame:
    """node, neighbour, p: the probability with which tables of two levels draw each neighbour."""
    of_chunk = alias_probabilities(top).select("node", F.col("neighbour").alias("chunk"), F.col("p").alias("q"))
    return alias_probabilities(low, ("node", "chunk")).join(of_chunk, ["node", "chunk"]).select("node", "neighbour", (F.col("p") * F.col("q")).alias("p"))


def alias_probabilities(tables: DataFrame, by: tuple[str, ...] = ("node",)) -> DataFrame:
    """by, neighbour, p: the probability with which an alias table draws each neighbour."""
    cells = alias_places(tables, by)
    own = cells.select(*by, "neighbour", (F.col("threshold") / F.col("k")).alias("p"))
    other = cells.select(*by, F.col("other").alias("neighbour"), ((1 - F.col("threshold")) / F.col("k")).alias("p"))
    return own.unionByName(other).groupBy(*by, "neighbour").agg(F.sum("p").alias("p"))
