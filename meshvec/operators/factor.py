"""Tall panels (i, y) and randomized factorization: only d x d matrices reach the driver."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshvec.functions.lineage import cut
from meshvec.operators.masks import normal_panel

#: Triangles that one reduces to the next level of a QR's tree, on the average, and that reach the driver at most.
FAN = 16
#: Directions smaller than this share of the largest are taken as dependent on the others.
DEPENDENT = 1e-14
#: Cells of a part of a placed matrix and numbers of its panel, numbers of a stretch's panel, all on the average, columns of which a list is broadcast at most, and products that are held at once.
PART_CELLS, PART_NUMBERS, STRETCH_NUMBERS, LISTED, AT_ONCE = 12_000_000, 8_000_000, 500_000, 1_000_000, 500_000


def panel_dot(m: DataFrame, y: DataFrame, d: int, by: tuple[str, ...] = ()) -> DataFrame:
    """M Y: a join on the inner index and d sums for each row, combined map-side. by: keys of m to keep apart, such as the party."""
    joined = m.join(y.select(F.col("i").alias("j"), "y"), "j")
    sums = [F.sum(F.col("v") * F.col("y")[k]).alias(f"s{k}") for k in range(d)]
    return joined.groupBy("i", *by).agg(*sums).select("i", *by, F.array(*[f"s{k}" for k in range(d)]).alias("y"))


@contextmanager
def batches_by_rows(spark: SparkSession) -> Iterator[None]:
    """Batches that tasks get are bounded by their rows alone, inside: rows of a panel are of one size, and Spark tells a batch's bytes anew at every row, which takes longer than products do."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(2**31 - 1))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class _Sums:
    """Rows of d sums by id, whose space grows with the ids."""

    def __init__(self, d: int) -> None:
        self.ids, self.place, self.out = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, d))

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Where in out the given ids, sorted and different, have their sums."""
        at, n = np.searchsorted(self.ids, ids), len(self.ids)
        new = np.flatnonzero(self.ids[np.minimum(at, n - 1)] != ids) if n else np.arange(len(ids))
        if len(new):
            if n + len(new) > len(self.out):
                grown = np.zeros((max(n + len(new), 2 * n), self.out.shape[1]))
                grown[:n] = self.out[:n]
                self.out = grown
            self.place = np.insert(self.place, at[new], np.arange(n, n + len(new)))
            self.ids = np.insert(self.ids, at[new], ids[new])
            at = np.searchsorted(self.ids, ids)
        return self.place[at]

    def batch(self) -> pa.RecordBatch:
        n, d = len(self.ids), self.out.shape[1]
        ids = np.empty(n, np.int64)
        ids[self.place] = self.ids
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(self.out[:n].ravel()))], ["i", "y"])


def _sorted(rows: list[tuple[np.ndarray, np.ndarray]], d: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows of a panel that came in pieces, by id."""
    ids, x = np.concatenate([np.zeros(0, np.int64), *(r[0] for r in rows)]), np.concatenate([np.zeros((0, d)), *(r[1] for r in rows)])
    order = np.argsort(ids)
    return ids[order], x[order]


class Placed:
    """A sparse matrix in parts, to be multiplied by panels from either side.

    A cell lies where its row or its column is at home, whichever has fewer
    cells: with its column if that has no more than the mean row, else with its
    row. So a column or row of few cells is needed, and added up, in one part,
    and only those of many in several: a multiplication shuffles a row of the
    panel, and one of the sums, for each part that has a node, not for each cell.

    A part's homes are dealt to stretches, which a task takes one after the other: it
    holds the rows of the panel and the sums of one stretch, besides the rows that
    several stretches of its part need, and cells pass by in batches.
    """

    def __init__(self, cells: DataFrame, d: int) -> None:
        """cells: i, j, v; d: the width of the widest panel."""
        spark = cells.sparkSession
        n, rows, columns = cells.agg(F.count(F.lit(1)), F.approx_count_distinct("i"), F.approx_count_distinct("j")).first()
        parts = max(spark.sparkContext.defaultParallelism, -(-n // PART_CELLS), -(-max(rows, columns) * d // PART_NUMBERS))
        stretches = max(1, -(-max(rows, columns) * d // (parts * STRETCH_NUMBERS)))
        keys = spark.range(64 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("p")).agg(F.min("id").alias("key"))  # numbers that are dealt to different partitions
        keys = F.array(*[F.lit(row["key"]) for row in keys.orderBy("p").collect()])
        wide = cut(cells.groupBy("j").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > n / max(1, rows)).select("j", F.lit(True).alias("wide")))
        wide = F.broadcast(wide) if wide.count() <= LISTED else wide
        home = F.when(F.col("wide"), F.col("i")).otherwise(F.col("j"))
        step = (F.pmod(F.hash(home), F.lit(stretches)) * 2 + 2).cast("int")
        placed = cells.join(wide, "j", "left").select(F.get(keys, F.pmod(F.xxhash64(home), F.size(keys)).cast("int")).alias("part"), step.alias("step"), "i", "j", "v")
        self.parts = parts
        self.cells = placed.repartition(parts, "part").sortWithinPartitions("part", "step").persist(StorageLevel.MEMORY_AND_DISK)
        needed = F.when(F.min("step") == F.max("step"), F.min("step") - 1).otherwise(F.lit(0)).alias("step")
        self.where = {c: self.cells.groupBy("part", F.col(c).alias("i")).agg(needed).repartition(parts, "i").persist(StorageLevel.MEMORY_AND_DISK) for c in "ij"}

    def dot(self, y: DataFrame, d: int, turned: bool = False) -> DataFrame:
        """M Y, or M'Y if turned.

        A part is a stream in the order of steps: 0 has the rows of the panel that several
        stretches need, 1 those of the first stretch alone, 2 its cells, and so on.
        """
        inner, outer = ("i", "j") if turned else ("j", "i")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, rows, several, own, sums = 0, [], None, None, _Sums(d)
            for batch in batches:
                steps = batch.column("step").to_numpy()
                cuts = np.flatnonzero(np.r_[True, steps[1:] != steps[:-1]]).tolist() if len(steps) else []
                for lo, hi in zip(cuts, [*cuts[1:], len(steps)], strict=True):
                    at, piece = int(steps[lo]), batch.slice(lo, hi - lo)
                    if at < now:
                        raise RuntimeError("the rows of a part came out of order")
                    if several is None and at > 0:
                        several, rows = _sorted(rows, d), []
                    if (at - 1) // 2 != (now - 1) // 2:
                        if len(sums.ids):
                            yield sums.batch()
                        own, sums = None, _Sums(d)
                    now = at
                    if at == 0 or at % 2:
                        rows.append((piece.column("i").to_numpy(), piece.column("y").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)))
                        continue
                    if own is None:
                        own, rows = _sorted(rows, d), []
                    for first in range(0, hi - lo, max(1, AT_ONCE // d)):
                        some = piece.slice(first, max(1, AT_ONCE // d))
                        k, v = some.column(inner).to_numpy(), some.column("v").to_numpy()
                        ids, row = np.unique(some.column(outer).to_numpy(), return_inverse=True)
                        place = sums.places(ids)
                        for known, x in (several, own):
                            if len(known):
                                met = np.minimum(np.searchsorted(known, k), len(known) - 1)
                                mine = np.flatnonzero(known[met] == k)
                                mine = mine[np.argsort(row[mine], kind="stable")]
                                if len(mine):
                                    starts = np.flatnonzero(np.r_[True, np.diff(row[mine]) != 0])
                                    sums.out[place[row[mine[starts]]]] += np.add.reduceat(v[mine, None] * x[met[mine]], starts)
            if len(sums.ids):
                yield sums.batch()

        sent = y.join(self.where[inner], "i").select("part", "step", "i", F.lit(None).cast("long").alias("j"), F.lit(None).cast("double").alias("v"), "y")
        stream = sent.repartition(self.parts, "part").unionByName(self.cells.withColumn("y", F.lit(None).cast("array<double>")))  # cells stay where they are
        summed = stream.sortWithinPartitions("part", "step").groupBy("part").applyInArrow(run, "i long, y array<double>")
        return panel_sum(summed, d)

    def release(self) -> None:
        for table in (self.cells, *self.where.values()):
            table.unpersist()


def panel_sum(panels: DataFrame, d: int) -> DataFrame:
    """The sum over parties of panels with the same rows."""
    return panels.groupBy("i").agg(*[F.sum(F.col("y")[k]).alias(f"s{k}") for k in range(d)]).select("i", F.array(*[f"s{k}" for k in range(d)]).alias("y"))


def gram(y: DataFrame, d: int) -> np.ndarray:
    """Y'Y. Each task sends its upper triangle, the triangles are summed by a shuffle, and d (d + 1) / 2 numbers reach the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                g += x.T @ x
        k, m = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(m, pa.int32()), pa.array(g[k, m])], ["k", "m", "v"])

    out = np.zeros((d, d))
    for r in y.select("y").mapInArrow(part, "k int, m int, v double").groupBy("k", "m").agg(F.sum("v").alias("v")).collect():
        out[r["k"], r["m"]] = out[r["m"], r["k"]] = r["v"]
    return out


def map_rows(y: DataFrame, w: np.ndarray) -> DataFrame:
    """Y W for a small W, in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(w)) @ w
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["i", "y"])

    return y.select("i", "y").mapInArrow(run, "i long, y array<double>")


def triangle(y: DataFrame, d: int) -> np.ndarray:
    """The triangle R of Y's QR, by a tree of small ones: each task reduces its rows batch by batch, then groups of tasks reduce theirs, and FAN triangles reach the driver.

    Householder's QR at every level keeps the accuracy of a QR of the whole
    panel; Y'Y, whose condition is the square of Y's, is never formed.
    """

    def reduced(batches: Iterator[pa.RecordBatch], shape: tuple[int, int]) -> Iterator[pa.RecordBatch]:
        key, r = None, np.zeros((0, d))

        def row() -> pa.RecordBatch:
            full = np.zeros((d, d))
            full[: len(r)] = r
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([full.ravel()], pa.list_(pa.float64()))], ["p", "r"])

        for batch in batches:
            keys = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(keys), *shape)
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist() if len(keys) else []
            for start, end in zip(cuts, [*cuts[1:], len(keys)], strict=False):
                if keys[start] != key:
                    if key is not None:
                        yield row()
                    key, r = int(keys[start]), np.zeros((0, d))
                r = np.linalg.qr(np.vstack([r, x[start:end].reshape(-1, d)]), mode="r")
        if key is not None:
            yield row()

    level = y.select(F.spark_partition_id().alias("p"), "y").mapInArrow(lambda b: reduced(b, (d,)), "p int, r array<double>")
    for groups in (FAN * FAN, FAN):
        level = level.select(F.pmod("p", F.lit(groups)).alias("p"), "r").repartition("p").sortWithinPartitions("p").mapInArrow(lambda b: reduced(b, (d, d)), "p int, r array<double>")
    found = [np.array(row["r"]).reshape(d, d) for row in level.collect()]
    return np.linalg.qr(np.vstack([np.zeros((0, d)), *found]), mode="r") if found else np.zeros((0, d))


def orthonormal(y: DataFrame, d: int) -> tuple[DataFrame, int]:
    """An orthonormal basis of Y's columns and its width.

    R comes from a tree of QRs, and Q is Y solved for it, row by row; doing that
    twice makes Q'Q the identity to rounding for any condition that doubles can
    tell from a singular one. Directions of less than DEPENDENT of the largest
    are rounding errors of the others: they are dropped, and Q is narrower then,
    where a dense QR would fill up with arbitrary directions.
    """
    for _ in range(2):
        _, size, axes = np.linalg.svd(triangle(y, d), full_matrices=False)
        keep = size > DEPENDENT * max(size.max(initial=0.0), 1e-300)
        w = axes[keep].T / size[keep]
        y, d = cut(map_rows(y, w)), w.shape[1]
    return y, d


def randomized_svd(m: DataFrame, d: int, *, rounds: int = 7, seed: int = 3, oversample: int = 8) -> tuple[DataFrame, np.ndarray]:
    """Left singular vectors (i, y) and singular values of the d leading directions of a sparse matrix.

    A random panel is multiplied by M (M'M)^rounds, orthonormalized each round
    (the span is that of the plain power, without its loss of digits) and
    checkpointed, so the plan doesn't grow. B = Q'M is kept as the panel M'Q,
    whose Gram matrix gives the small eigenproblem. M is dealt to parts once and
    persisted, so a multiplication shuffles the panel and the partial sums but
    not M, and those once for each part that has a node (Placed).
    """
    cells = cut(m.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")).filter("v != 0"))
    if cells.isEmpty():
        return cells.select("i", F.array().cast("array<double>").alias("y")), np.zeros(0)
    placed = Placed(cells, d + oversample)
    nodes = cells.select(F.col("j").alias("node")).distinct()
    width = min(d + oversample, max(1, nodes.count()))
    with batches_by_rows(m.sparkSession):
        y, width = orthonormal(cut(placed.dot(normal_panel(nodes, width, seed), width)), width)
        for _ in range(rounds):
            z, width = orthonormal(cut(placed.dot(y, width, turned=True)), width)
            y, width = orthonormal(cut(placed.dot(z, width)), width)
        bt = cut(placed.dot(y, width, turned=True))
    placed.release()
    _, values, axes = np.linalg.svd(triangle(bt, width), full_matrices=False)
    return map_rows(y, axes[:d].T), values[:d]


def svd_to_tolerance(m: DataFrame, d: int, *, tolerance: float = 1e-6, expansions: int = 2, oversample: int = 8, cycles: int = 50, seed: int = 3) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Left singular vectors, singular values and error bounds of the d leading directions, by block Lanczos with restarts until each bound is `tolerance` of the largest value.

    A cycle expands a panel to the block Krylov space of MM' (`expansions` more
    panels of its width), takes the best approximations in that space, and
    starts again from them. With v = M'u / s, a singular value of M lies within
    |Mv - su| / sqrt(2) of s: that bound is measured from panels, for what is
    returned, and doesn't rest on how many rounds were made. After `cycles`
    cycles what there is is returned with its bounds, larger ones then.
    """
    cells = cut(m.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")).filter("v != 0"))
    if cells.isEmpty():
        return cells.select("i", F.array().cast("array<double>").alias("y")), np.zeros(0), np.zeros(0)
    placed = Placed(cells, (1 + expansions) * (d + oversample))
    nodes = cells.select(F.col("j").alias("node")).distinct()
    width = min(d + oversample, max(1, nodes.count()))
    with batches_by_rows(m.sparkSession):
        q, width = orthonormal(cut(placed.dot(normal_panel(nodes, width, seed), width)), width)
        for _ in range(cycles):
            wide, total, last, size = q, width, q, width
            for _ in range(expansions):
                z, size = orthonormal(cut(placed.dot(last, size, turned=True)), size)
                last, size = orthonormal(cut(placed.dot(z, size)), size)
                wide = wide.join(last.withColumnRenamed("y", "more"), "i").select("i", F.concat("y", "more").alias("y"))
                total += size
            wide, total = orthonormal(cut(wide), total)
            bt = cut(placed.dot(wide, total, turned=True))
            _, values, axes = np.linalg.svd(triangle(bt, total), full_matrices=False)
            kept = int((values[: d + oversample] > DEPENDENT * values[0]).sum())
            values, axes = values[:kept], axes[:kept].T
            q, width = cut(map_rows(wide, axes)), kept
            mv = placed.dot(map_rows(bt, axes / values), kept)
            both = mv.select("i", F.col("y").alias("mv")).join(q, "i")
            off = [F.sum((F.col("mv")[k] - F.lit(float(values[k])) * F.col("y")[k]) ** 2) for k in range(min(d, kept))]
            bounds = np.sqrt(np.array(both.agg(*off).first(), float) / 2)
            if bounds.max() <= tolerance * values[0]:
                break
    placed.release()
    first = min(d, kept)
    return map_rows(q, np.eye(kept, first)), values[:first], bounds


def l2_normalize(panel: DataFrame) -> DataFrame:
    """Rows of length 1; zero rows stay zero."""
    norm = F.sqrt(F.aggregate("y", F.lit(0.0), lambda s, x: s + x * x))
    return panel.withColumn("n", norm).select("i", F.transform("y", lambda x: F.when(F.col("n") > 0, x / F.col("n")).otherwise(F.lit(0.0))).alias("y"))


def embedding(m: DataFrame, nodes: DataFrame, d: int, *, rounds: int = 7, seed: int = 3, normalize: bool = True, tolerance: float | None = None) -> DataFrame:
    """node, vec: left singular vectors times the roots of singular values; nodes without cells, and directions beyond the rank, get zeros.

    With a tolerance the factorization goes on until its error bounds meet it; else it makes `rounds` rounds.
    """
    if tolerance is None:
        u, s = randomized_svd(m, d, rounds=rounds, seed=seed)
    else:
        u, s, _ = svd_to_tolerance(m, d, tolerance=tolerance, seed=seed)
    scaled = map_rows(u, np.eye(len(s), d) * np.sqrt(s)[:, None])
    scaled = l2_normalize(scaled) if normalize else scaled
    zeros = F.array(*[F.lit(0.0)] * d)
    return nodes.join(scaled, nodes["node"] == scaled["i"], "left").select("node", F.coalesce("y", zeros).alias("vec"))


def as_dictionary(emb: DataFrame) -> DataFrame:
    """node as text and its vector as JSON, the shape of a dictionary file."""
    return emb.select(F.col("node").cast("string").alias("node"), F.to_json("vec").alias("vec"))


def communication(held: DataFrame, nodes: DataFrame, d: int, rounds: int) -> DataFrame:
    """party, bytes: what a party sends and gets in the sampled protocol, at 8 bytes a number.

    Degrees once up and once down; one n x d panel up and one down for each of
    the 2 * rounds + 1 multiplications; the n x d matrix B once up.
    """
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    parties = held.select("party").distinct()
    return parties.join(F.broadcast(n)).select("party", (F.col("n") * 8 * (2 + 2 * d * (2 * rounds + 1) + d)).cast("long").alias("bytes"))  # n is one row
