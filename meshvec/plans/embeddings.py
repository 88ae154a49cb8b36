"""Whole runs: from edges to node vectors."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshvec.functions.lineage import cut
from meshvec.operators import edges as E
from meshvec.operators import evaluate, factor, matrix, proximity, stats, walks


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def exact_embedding(edges: DataFrame, d: int, *, window: int = 1, negative: float = 1.0, rounds: int = 5, seed: int = 3, tolerance: float | None = None) -> DataFrame:
    """node, vec from the exact proximity of the given window; edges: src, dst, w of all parties together."""
    kept = cut(edges)
    m = proximity.truncated_log(proximity.proximity(matrix.from_edges(kept), stats.in_degree(kept), stats.volume(kept, "sum_weights"), window=window, negative=negative))
    return factor.embedding(m, nodes_of(kept), d, rounds=rounds, seed=seed, normalize=False, tolerance=tolerance)


def sampled_embedding(
    split: DataFrame,
    d: int,
    *,
    parties: int,
    window: int = 1,
    per_edge: int = 500,
    workers: int = 8,
    negative: float = 1.0,
    rounds: int = 7,
    seed: int = 3,
    log_mode: str = "per_party",
    directed: bool = True,
    volume: str = "sum_weights",
    normalize: bool = True,
    diagonal: bool = True,
    **draws,
) -> DataFrame:
    """node, vec from path sampling; split: src, dst, party as split_parties gives it.

    directed=False walks each edge from either end at random; volume is a mode
    of stats.volume over the lines of all parties; diagonal=False leaves cells
    of a node with itself out before the factorization; draws go to path_samples
    (weighted=True walks by column w of split; degrees count edges all the same).
    """
    walked = cut(split.groupBy("src", "dst", "party").agg(F.sum("w").alias("w")) if draws.get("weighted") else E.party_edges(split))
    held = walked.withColumn("w", F.lit(1.0))
    by_party = stats.in_degree(held, ("party",))
    degree = cut(stats.global_degree(by_party))
    vol = stats.volume(held if volume == "sum_weights" else split, volume).first()[0]
    sampled = cut(walks.path_samples(walked, window=window, per_edge=per_edge, workers=workers, parties=parties, directed=directed, seed=seed, **draws))
    m = walks.sampled_proximity(sampled, by_party, degree, float(vol), negative=negative, log_mode=log_mode)
    return factor.embedding(m if diagonal else m.filter("i != j"), nodes_of(held), d, rounds=rounds, seed=seed, normalize=normalize)


def evaluated(split: DataFrame, truth: DataFrame, d: int, *, model: str, task: str, fractions: list[float], parties: int, repeats: int = 1, rounds: int = 7, **settings) -> DataFrame:
    """Embed, time, classify: the record of evaluate.report, to be added to a file by graphs.append_results. truth: node, label; settings go to sampled_embedding."""
    began = time.time()
    vectors = cut(sampled_embedding(split, d, parties=parties, rounds=rounds, **settings))
    seconds = time.time() - began
    traffic = factor.communication(split, nodes_of(split), d, rounds).agg(F.sum("bytes")).first()[0]
    scores = evaluate.classify(vectors.join(truth.select("node").distinct(), "node", "left_semi"), truth, fractions, repeats=repeats)
    return evaluate.report(scores, model=model, task=task, seconds=seconds, parties=parties, communication=traffic or 0)
