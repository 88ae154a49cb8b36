"""Exact random-walk proximity: X = D^-1 A with the in-degrees of the whole graph, its powers, and the truncated logarithm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshvec.functions.lineage import cut
from meshvec.operators import matrix


def row_normalized(a: DataFrame, degree: DataFrame) -> DataFrame:
    """X = D^-1 A. degree: node, deg."""
    return matrix.diag_left(matrix.diagonal(degree), a, inverse=True)


def truncated_log(m: DataFrame) -> DataFrame:
    """ln(max(v, 1)): cells up to 1 vanish, so the result stays sparse and exact."""
    return m.filter("v > 1").select("i", "j", F.ln("v").alias("v"))


def with_unit(m: DataFrame, x: DataFrame) -> DataFrame:
    """M + I on the rows of x, as cells that add up."""
    one = x.select("i").distinct().select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))
    return m.select("i", "j", "v").unionByName(one)


def power_sum(x: DataFrame, window: int) -> DataFrame:
    """X + X^2 + ... + X^window by (... (X + I) X + I) X, so each sum is a product and no cells are added up after it. X and the sums before the last are checkpointed, since each serves twice."""
    x = cut(x) if window > 1 else x
    out = x
    for k in range(2, window + 1):
        out = matrix.dot(with_unit(out, x), x)
        out = cut(out) if k < window else out
    return out


def proximity(a: DataFrame, degree: DataFrame, vol: DataFrame, *, window: int = 1, negative: float = 1.0) -> DataFrame:
    """vol / (window * negative) * (X + ... + X^window) D^-1, before the logarithm. vol: one row.

    Windows 1 and 2 are the forms in use; larger ones are an extension. The
    last product's right side is X D^-1, so its cells, which can be nearly as many as pairs of nodes,
    are whole as a task makes them and are never shuffled.
    """
    x = row_normalized(a, degree)
    x = cut(x) if window > 1 else x
    scaled = matrix.diag_right(x, matrix.diagonal(degree), inverse=True)
    if window > 1:
        scaled = matrix.dot(with_unit(power_sum(x, window - 1), x), scaled).filter("v != 0")
    factor = vol.select((F.col("vol") / F.lit(window * negative)).alias("c"))
    return scaled.join(F.broadcast(factor)).select("i", "j", (F.col("v") * F.col("c")).alias("v"))  # vol is one row


def party_squares(x: DataFrame, parties: int) -> DataFrame:
    """(sum of X_p)^2 from what pairs of parties can compute: the squares of pair sums, less (parties - 2) own squares. x: i, j, v, party."""
    x = cut(x)
    own = [x.filter(F.col("party") == p).select("i", "j", "v") for p in range(1, parties + 1)]
    terms = []
    for p in range(parties):
        for q in range(p + 1, parties):
            both = matrix.add((1.0, own[p]), (1.0, own[q]))
            terms.append((1.0, matrix.dot(both, both)))
    terms += [(-(parties - 2.0), matrix.dot(m, m)) for m in own if parties != 2]
    return matrix.add(*terms)


def party_proximity(x: DataFrame, degree: DataFrame, vol: DataFrame, parties: int, *, negative: float = 1.0) -> DataFrame:
    """The proximity of window 2 from the parties' shares: vol / (2 * negative) (sum of X_p + square of the sum) D^-1, the square by party_squares. x: i, j, v, party."""
    x = cut(x)
    both = matrix.add((1.0, x.select("i", "j", "v")), (1.0, party_squares(x, parties)))
    scaled = matrix.diag_right(both, matrix.diagonal(degree), inverse=True)
    factor = vol.select((F.col("vol") / F.lit(2 * negative)).alias("c"))
    return scaled.join(F.broadcast(factor)).select("i", "j", (F.col("v") * F.col("c")).alias("v"))  # vol is one row
