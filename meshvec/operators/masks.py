"""Additive and orthogonal masks and the two-party protocol over them. A simulation of the arithmetic; no privacy is claimed.

Masks are dense, so they and what they are multiplied with are block matrices
(see blocks). Every mask has a block size, which bounds what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshvec.functions.columns import hash_mask, hash_normal
from meshvec.functions.lineage import cut
from meshvec.operators import blocks, matrix


def random_blocks(spark: SparkSession, n: int, size: int, seed: int) -> DataFrame:
    """A block-diagonal matrix of uniforms in [0, 10)."""
    return blocks.diagonal(spark, n, size, lambda b, k: random_block(seed, b, k))


def random_matrix(spark: SparkSession, n: int, seed: int, size: int) -> DataFrame:
    """random_blocks as cells."""
    return blocks.from_blocks(random_blocks(spark, n, size, seed), size)


def normal_panel(nodes: DataFrame, d: int, seed: int) -> DataFrame:
    """i, y: d standard normal entries for each node."""
    return nodes.select(F.col("node").alias("i"), F.array(*[hash_normal(seed + k, "node") for k in range(d)]).alias("y"))


def orthogonal_block(seed: int, b: int, k: int) -> np.ndarray:
    """Block b of an orthogonal mask, k x k: Q of the QR of normals."""
    q, r = np.linalg.qr(np.random.default_rng([seed, b]).normal(size=(k, k)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def orthogonal_blocks(spark: SparkSession, n: int, size: int, seed: int) -> DataFrame:
    """A block-diagonal orthogonal matrix."""
    return blocks.diagonal(spark, n, size, lambda b, k: orthogonal_block(seed, b, k))


def mask(p: DataFrame, a: DataFrame, q: DataFrame, size: int) -> DataFrame:
    """P A Q."""
    return blocks.dot(blocks.dot(p, a, size), q, size)


def demask(p: DataFrame, masked: DataFrame, q: DataFrame, size: int) -> DataFrame:
    """P' M Q', which undoes mask for orthogonal P and Q."""
    return blocks.dot(blocks.dot(blocks.transpose(p, size), masked, size), blocks.transpose(q, size), size)


def masked_square(p: DataFrame, x: DataFrame, q: DataFrame, size: int) -> DataFrame:
    """P X^2 Q of a party that holds all of X."""
    return blocks.dot(blocks.dot(blocks.dot(p, x, size), x, size), q, size)


def secure_sum(held: DataFrame, parties: int, seed: int) -> DataFrame:
    """Sum of the parties' matrices from what each publishes: its own cells plus the masks it gave less the masks it got.

    held: i, j, v, party 1..parties. The mask that p gives to q for a cell is a
    hash of (p, q, i, j); every party masks every cell that any of them has.
    """
    cells = held.select("i", "j").distinct()
    others = F.explode(F.sequence(F.lit(1), F.lit(parties)))
    pairs = cells.select("i", "j", others.alias("party")).select("*", others.alias("q")).filter("party != q")
    given = pairs.select("i", "j", "party", (hash_mask(seed, "party", "q", "i", "j") - hash_mask(seed, "q", "party", "i", "j")).alias("v"))
    published = held.select("i", "j", "party", "v").unionByName(given).groupBy("i", "j", "party").agg(F.sum("v").alias("v"))
    return published.groupBy("i", "j").agg(F.sum("v").alias("v"))


def protocol_square(spark: SparkSession, xa: DataFrame, xb: DataFrame, n: int, *, size: int, seed: int = 11, right: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(X_a + X_b)^2 by the masked exchange of two parties; all matrices are blocks. With right (Y_a, Y_b) it is (X_a + X_b) (Y_a + Y_b).

    A third side deals residual masks R_a0, R_a1 and R_b0, R_b1, and a noise T
    whose correction C it keeps; each party publishes X minus its masks, one
    forms W, the other U, and U + T + T' is the square whatever the masks are.
    """
    dot = lambda a, b: blocks.dot(a, b, size)
    add = lambda *terms: cut(blocks.add(size, *terms))
    xa, xb = cut(xa), cut(xb)
    ya, yb = (cut(y) for y in right) if right else (xa, xb)
    ra0, ra1, rb0, rb1, t, t2 = (cut(random_blocks(spark, n, size, seed + k)) for k in range(6))
    c = add((1, dot(ra0, rb1)), (1, dot(rb0, ra1)), (-1, t))
    a0, a1 = add((1, xa), (-1, ra0)), add((1, ya), (-1, ra1))
    b0, b1 = add((1, xb), (-1, rb0)), add((1, yb), (-1, rb1))
    w = add((1, dot(ra0, b1)), (1, dot(b0, ra1)), (1, dot(xa, ya)), (-1, t2))
    u = add((1, dot(a0, yb)), (1, dot(xb, a1)), (1, dot(xb, yb)), (1, w), (1, c))
    return blocks.add(size, (1, u), (1, t), (1, t2))


def demasked_sum(held: list[DataFrame], factor: float, n: int, *, size: int, seed: int, least: float) -> DataFrame:
    """The cells larger than `least` of P' (factor * sum of P X Q) Q', X being each of held (blocks), P and Q the orthogonal masks of seed and seed + 1.

    The masks are block-diagonal, so a block of a message P X Q is made of one
    block of X. Blocks of X meet by place, packed; the task makes the two blocks
    of the masks that it needs, sends each through its mask, adds up what was
    sent and undoes the masks. So masked blocks, which are dense, and masks are
    neither moved nor stored. A task takes cells of a grid of BAND x BAND blocks
    and holds the masks of one cell.
    """
    band = blocks.BAND
    width = lambda b: min(size, n - b * size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, block, sent = None, None, None
        made: dict[tuple[int, int], np.ndarray] = {}

        def of(side: int, b: int) -> np.ndarray:
            if (side, b) not in made:
                made[side, b] = orthogonal_block(seed + side, b, width(b))
            return made[side, b]

        def opened() -> pa.RecordBatch:
            bi, bj = block
            x = np.zeros((size, size))
            x[: width(bi), : width(bj)] = of(0, bi).T @ (factor * sent) @ of(1, bj).T
            return blocks.cells(bi, bj, x.ravel(), size, least)

        for t in batches:
            for bi, bj, x in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), blocks.arrays(t.column(2), size * size), strict=True):
                if (bi, bj) != block:
                    if block is not None:
                        yield opened()
                    block, sent = (bi, bj), np.zeros((width(bi), width(bj)))
                    if (bi // band, bj // band) != cell:
                        cell = (bi // band, bj // band)
                        made.clear()
                rows, columns, x = blocks.trimmed(x.reshape(size, size))
                sent += of(0, bi)[:, rows] @ x @ of(1, bj)[columns]
        if block is not None:
            yield opened()

    met = reduce(DataFrame.unionByName, [x.select("bi", "bj", "x") for x in held])
    grid = [F.floor(F.col(c) / band) for c in ("bi", "bj")]
    return met.repartition(*grid).sortWithinPartitions(*grid, "bi", "bj").mapInArrow(run, "i long, j long, v double")


def random_block(seed: int, b: int, k: int) -> np.ndarray:
    """Block b of a mask of uniforms in [0, 10), k x k."""
    return np.random.default_rng([seed, b]).random((k, k)) * 10


def masked_square_sum(xs: list[DataFrame], ys: list[DataFrame], factor: float, n: int, *, size: int, seed: int, least: float) -> DataFrame:
    """The cells larger than `least` of P' (factor * (P Y_a Q + P Y_b Q + P S Q)) Q', S = (X_a + X_b) (Y_a + Y_b) being made by the exchange of protocol_square with the masks of seed + 2 on; all are blocks.

    S is dense, and so are its masked forms, so none of them is moved: a task of
    the product's grid adds up the products of the parties' own blocks, and makes the
    blocks of the masks that a block of S needs. The residual masks are
    block-diagonal: what they are multiplied with is the block of X or Y in the same place, which comes along.
    """
    width = lambda b: min(size, n - b * size)
    made: dict[tuple[int, int], np.ndarray] = {}

    def of(m: int, b: int) -> np.ndarray:  # 0 and 1 are P and Q, 2 to 7 the masks of the exchange
        if (m, b) not in made:
            while len(made) >= blocks.KEPT:
                made.pop(next(iter(made)))
            made[m, b] = orthogonal_block(seed + m, b, width(b)) if m < 2 else random_block(seed + m, b, width(b))
        return made[m, b]

    def opened(bi: int, bj: int, s: np.ndarray, others: dict[int, np.ndarray]) -> pa.RecordBatch:
        rows, columns = width(bi), width(bj)
        none = np.zeros((rows, columns))
        s = s[:rows, :columns]  # X_a Y_a + X_b Y_b + X_a Y_b + X_b Y_a
        xb, ya, yb = (others[t][:rows, :columns] if t in others else none for t in range(3))
        if 0 in others or 2 in others or bi == bj:
            b0, b1 = xb - of(4, bi) if bi == bj else xb, yb - of(5, bi) if bi == bj else yb
            s = s + of(2, bi) @ b1 + b0 @ of(3, bj)  # W; U has (X_a - R_a0) Y_b and X_b (Y_a - R_a1)
            s = s - of(2, bi) @ yb - xb @ of(3, bj)
        if bi == bj:
            noise, second = of(6, bi), of(7, bi)
            c = of(2, bi) @ of(5, bi) + of(4, bi) @ of(3, bi) - noise
            s = (s - second + c) + noise + second
        sent = np.zeros((rows, columns))
        for x in (s, ya, yb):
            if x is not none:
                r, k, x = blocks.trimmed(x)
                sent += of(0, bi)[:, r] @ x @ of(1, bj)[k]
        x = np.zeros((size, size))
        x[:rows, :columns] = of(0, bi).T @ (factor * sent) @ of(1, bj).T
        return blocks.cells(bi, bj, x.ravel(), size, least)

    count = -(-n // size)
    lines = lambda m, inner, k: m.select(*[(F.col(c) + k * count).alias(c) if c == inner else c for c in ("bi", "bj", "x")])
    (xa, xb), (ya, yb) = xs, ys
    left = reduce(DataFrame.unionByName, [lines(m, "bj", k) for k, m in enumerate((xa, xb, xa, xb))])
    right = reduce(DataFrame.unionByName, [lines(m, "bi", k) for k, m in enumerate((ya, yb, yb, ya))])
    return blocks.dot(left, right, size, finish=opened, beside=(xb, ya, yb), ddl="i long, j long, v double")


def masked_proximity(spark: SparkSession, xs: list[DataFrame], degree: DataFrame, vol: float, n: int, *, window: int = 1, negative: float = 1.0, size: int, seed: int = 31, least: float = 1e-8) -> DataFrame:
    """The proximity of window 1 or 2 as two parties compute it under masks P and Q, demasked again, as cells larger than `least`.

    xs: each party's X_p = D^-1 A_p (i, j, v) with the degrees of the whole
    graph. A party sends P (X_p D^-1) Q; for window 2 the square of the sum,
    times D^-1, comes from the exchange of protocol_square. The masks leave no trace but rounding.
    """
    if window not in (1, 2):
        raise ValueError("the protocol has windows 1 and 2")
    scaled = [cut(blocks.to_blocks(matrix.diag_right(x, matrix.diagonal(degree), inverse=True), size)) for x in xs]
    if window == 2:
        own = [cut(blocks.to_blocks(x, size)) for x in xs]
        return masked_square_sum(own, scaled, vol / (window * negative), n, size=size, seed=seed, least=least)
    return demasked_sum(scaled, vol / (window * negative), n, size=size, seed=seed, least=least)


def masked_sampled(m: DataFrame, o: DataFrame, size: int) -> DataFrame:
    """M O of a party's sampled proximity M (i, j, v) under an orthogonal mask O that all parties share, as blocks: what it sends instead of M."""
    return blocks.dot(blocks.to_blocks(m, size), o, size)
