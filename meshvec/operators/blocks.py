"""Matrices as square blocks: rows (bi, bj, x), x being the size * size cells of a block by row; absent blocks are zero.

A block with less than half of its cells is packed: its x holds the places of
the cells, then as many values, so it is shorter than size * size and the length
tells the forms apart. Blocks travel and are stored in the shorter form, and a
task unpacks one when it comes to it.

A matrix of n x n has ceil(n / size) blocks a side; the last ones are filled up
with zeros. One block fits a task's memory many times; sums of blocks hold no more
than KEPT of them, products SUMS cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshvec.functions.lineage import cut

#: Sums of blocks that a task keeps before it sends the oldest on.
KEPT = 64
#: Blocks a side of a cell of a grid of masked blocks (see masks).
BAND = 8
#: Sums that a task of a product holds at most; blocks of the inner index that one task takes if the product's grid has few cells, and tasks that such a grid has at most.
SUMS, INNER, SHARED = 1 << 25, 256, 16
#: Products that are added up at once.
AT_ONCE = 1 << 20
#: A line of the inner index is multiplied densely if each of its cells is in so many products on the average.
USES = 32
DDL = "bi long, bj long, x array<double>"
SCHEMA = pa.schema([("bi", pa.int64()), ("bj", pa.int64()), ("x", pa.list_(pa.float64()))])
#: Rows made of a finished block (bi, bj, block) and others of its place.
Finish = Callable[[int, int, np.ndarray, dict[int, np.ndarray]], pa.RecordBatch]


def packed(x: np.ndarray) -> np.ndarray:
    """The shorter form of the cells of a block."""
    x = x.ravel()
    at = np.flatnonzero(x)
    return np.concatenate([at, x[at]]) if 2 * len(at) < len(x) else x


def arrays(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each block of a column as `width` cells, one after the other."""
    flat, end = column.flatten().to_numpy(zero_copy_only=False), 0
    for n in column.value_lengths().to_pylist():
        x, end = flat[end : end + n], end + n
        if n != width:
            full = np.zeros(width)
            full[x[: n // 2].astype(np.int64)] = x[n // 2 :]
            x = full
        yield x


def stored_cells(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places and values of the cells of each block of a column; a packed block isn't unpacked."""
    flat, end = column.flatten().to_numpy(zero_copy_only=False), 0
    for n in column.value_lengths().to_pylist():
        x, end = flat[end : end + n], end + n
        if n == width:
            at = np.flatnonzero(x)
            yield at, x[at]
        else:
            yield x[: n // 2].astype(np.int64), x[n // 2 :]


def _together(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows whose last columns are arrays as batches of some rows and numbers."""
    some, held = [], 0
    for row in rows:
        some.append(row)
        held += sum(len(c) for c in row[2:])
        if len(some) >= 1000 or held >= 1 << 18:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            some, held = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _batch(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([packed(r[2]) for r in rows], SCHEMA.field("x").type)], schema=SCHEMA)


def trimmed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows and columns of a block that aren't empty, and its cells in them."""
    rows, columns = np.flatnonzero(x.any(1)), np.flatnonzero(x.any(0))
    return rows, columns, x[np.ix_(rows, columns)]


def _added(parts: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The sums of parts by block, as far as they come within KEPT different blocks of each other."""
    kept: dict[tuple[int, int], np.ndarray] = {}
    for bi, bj, x in parts:
        if (bi, bj) in kept:
            kept[bi, bj] += x
        else:
            if len(kept) >= KEPT:
                key = next(iter(kept))
                yield _batch([(*key, kept.pop(key))])
            kept[bi, bj] = np.array(x)
    for key, x in kept.items():
        yield _batch([(*key, x)])


def summed(parts: DataFrame, width: int) -> DataFrame:
    """Rows (bi, bj, x) of one key added up, x being `width` numbers, in one stream for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _added((i, j, x) for b in batches for i, j, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), arrays(b.column(2), width), strict=True))

    return parts.select("bi", "bj", "x").repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(run, DDL)


def to_blocks(a: DataFrame, size: int) -> DataFrame:
    """Coordinates (i, j, v) as blocks; a task takes them sorted by block and holds one at a time."""

    def whole(some: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        at, v = (np.concatenate(c) for c in zip(*some, strict=True))
        if 2 * len(at) >= size * size:
            return packed(np.bincount(at, v, size * size))
        at, place = np.unique(at, return_inverse=True)
        return np.concatenate([at, np.bincount(place, v, len(at))])

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        block, some, held = None, [], 0
        for t in batches:
            bi, bj, at, v = (t.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            starts = np.flatnonzero(np.r_[True, (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])]).tolist() if len(bi) else []
            for first, last in zip(starts, [*starts[1:], len(bi)], strict=False):
                if (bi[first], bj[first]) != block:
                    if block is not None:
                        yield *block, whole(some)
                    block, some, held = (bi[first], bj[first]), [], 0
                some.append((at[first:last], v[first:last]))
                held += last - first
                if held > 2 * size * size:  # cells that are listed again and again
                    sums = np.bincount(np.concatenate([x for x, _ in some]), np.concatenate([x for _, x in some]), size * size)
                    some, held = [(np.arange(size * size), sums)], size * size
        if block is not None:
            yield *block, whole(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _together(blocks_of(batches), SCHEMA)

    placed = a.select(F.floor(F.col("i") / size).alias("bi"), F.floor(F.col("j") / size).alias("bj"), (F.col("i") % size * size + F.col("j") % size).alias("at"), F.col("v").cast("double").alias("v"))
    return placed.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(run, DDL)


def cells(bi: int, bj: int, x: np.ndarray, size: int, least: float = 0.0) -> pa.RecordBatch:
    """The cells (i, j, v) of a block larger than `least` in size."""
    at = np.flatnonzero(np.abs(x) > least)
    return pa.RecordBatch.from_arrays([pa.array(bi * size + at // size), pa.array(bj * size + at % size), pa.array(x[at])], ["i", "j", "v"])


def from_blocks(a: DataFrame, size: int, least: float = 0.0) -> DataFrame:
    """The cells (i, j, v) larger than `least` in size; what is left of masks by rounding is dropped that way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bi, bj, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), arrays(b.column(2), size * size), strict=True):
                yield cells(bi, bj, x, size, least)

    return a.select("bi", "bj", "x").mapInArrow(run, "i long, j long, v double")


def _pieces(m: DataFrame, size: int, band: int, *, left: bool, dealt: bool) -> DataFrame:
    """k, g, p, v: the cells of the blocks of line k of the inner index in band g of the other one, as places and values.

    A place is the inner index within its block times the width of a band, plus
    the place in the band; values that are all equal stand there once. If the blocks
    aren't dealt by line, a line can have several pieces.
    """
    side, (inner, other) = band * size, ("bj", "bi") if left else ("bi", "bj")

    def piece(key: tuple[int, int], some: list[tuple[np.ndarray, np.ndarray]]) -> tuple:
        p, v = (np.concatenate(c) for c in zip(*some, strict=True))
        order = np.argsort(p, kind="stable")
        v = v[order]
        return *key, p[order].astype(np.int32), v[:1] if len(v) and (v == v[0]).all() else v

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, some = None, []
        for t in batches:
            for k, at, (x, v) in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), stored_cells(t.column(2), size * size), strict=True):
                if (k, at // band) != key:
                    if some:
                        yield piece(key, some)
                    key, some = (k, at // band), []
                row, column = x // size, x % size
                some.append(((column if left else row) * side + at % band * size + (row if left else column), v.copy()))
        if some:
            yield piece(key, some)

    schema = pa.schema([("k", pa.int64()), ("g", pa.int64()), ("p", pa.list_(pa.int32())), ("v", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _together(pieces(batches), schema)

    lines = m.select(inner, other, "x")
    if dealt:
        lines = lines.repartition(inner).sortWithinPartitions(inner, other)
    return lines.mapInArrow(run, "k long, g long, p array<int>, v array<double>").filter(F.size("p") > 0)


def _multiply(sums: np.ndarray, side: int, size: int, left: list, right: list) -> None:
    """Add the products of pieces (k, places, values) of lines to sums, a cell of side x side."""

    def joined(pieces: list) -> tuple[np.ndarray, ...]:
        n = [len(p) for _, p, _ in pieces]
        place = np.concatenate([p for _, p, _ in pieces]).astype(np.int64)
        line = np.repeat(np.array([k for k, _, _ in pieces], np.int64), n)
        return line, line * size + place // side, place % side, np.concatenate([v if len(v) == m else np.full(m, v[0]) for m, (_, _, v) in zip(n, pieces, strict=True)])

    (line, key, r, x), (other, at, c, y) = joined(left), joined(right)
    if (at[1:] < at[:-1]).any():
        order = np.argsort(at, kind="stable")
        other, at, c, y = other[order], at[order], c[order], y[order]
    low, high = np.searchsorted(at, key, "left"), np.searchsorted(at, key, "right")
    width = high - low
    lines, of = np.unique(line, return_inverse=True)
    made = np.bincount(of, width, len(lines))
    cells = np.bincount(of, minlength=len(lines)) + np.searchsorted(other, lines, "right") - np.searchsorted(other, lines, "left")
    dense = made > USES * cells
    for k in lines[dense].tolist():
        mine, yours = line == k, slice(np.searchsorted(other, k, "left"), np.searchsorted(other, k, "right"))
        (rows, to_row), (columns, to_column) = np.unique(r[mine], return_inverse=True), np.unique(c[yours], return_inverse=True)
        a, b = np.zeros((len(rows), size)), np.zeros((size, len(columns)))
        np.add.at(a, (to_row, key[mine] - k * size), x[mine])
        np.add.at(b, (at[yours] - k * size, to_column), y[yours])
        inner = np.flatnonzero(a.any(0) & b.any(1))
        sums.reshape(side, side)[np.ix_(rows, columns)] += a[:, inner] @ b[inner]
    kept = np.flatnonzero(~dense[of] & (width > 0))
    low, width, r, x = low[kept], width[kept], r[kept] * side, x[kept]
    ends = np.cumsum(width)
    first = 0
    while first < len(kept):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + AT_ONCE, side="right")))
        w = width[first:last]
        to = np.repeat(low[first:last] - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))
        np.add.at(sums, np.repeat(r[first:last], w) + c[to], np.repeat(x[first:last], w) * y[to])
        first = last


def _cell_sums(batches: Iterator[pa.RecordBatch], band: int, size: int, finish: Finish | None = None) -> Iterator[pa.RecordBatch]:
    """The blocks of each cell (gi, gj, gk) of the grid from rows (gi, gj, gk, k, side, places, values), sorted by these: pieces of the left (side 0) and of the right (1), addends (2, k -1), and blocks for finish (2, k less)."""
    side, cell, sums, left = band * size, None, None, []
    beside: dict[tuple[int, int], list[tuple[int, np.ndarray, np.ndarray]]] = {}

    def blocks_of() -> Iterator[pa.RecordBatch]:
        view = sums.reshape(side, side)
        for row in range(band):
            for column in range(band):
                x = view[row * size : (row + 1) * size, column * size : (column + 1) * size]
                of = beside.pop((row, column), [])
                if finish is not None and (of or x.any()):
                    others: dict[int, np.ndarray] = {}
                    for k, p, v in of:
                        np.add.at(others.setdefault(-2 - k, np.zeros((size, size))), (p // side - row * size, p % side - column * size), v)
                    yield finish(cell[0] * band + row, cell[1] * band + column, x.copy(), others)
                elif x.any():
                    yield _batch([(cell[0] * band + row, cell[1] * band + column, np.ascontiguousarray(x))])
                x[:] = 0

    for t in batches:
        keys = list(zip(*(t.column(c).to_pylist() for c in range(5)), strict=True))
        places, values = (t.column(c).flatten().to_numpy(zero_copy_only=False) for c in (5, 6))
        p_end, v_end = (np.cumsum(np.asarray(t.column(c).value_lengths(), np.int64)).tolist() for c in (5, 6))
        right = []
        for at, (*of, k, which) in enumerate(keys):
            if of != cell:
                if right:
                    _multiply(sums, side, size, left, right)
                if cell is not None:
                    yield from blocks_of()
                cell, left, right = of, [], []
                sums = np.zeros(side * side) if sums is None else sums
            p, v = places[p_end[at - 1] if at else 0 : p_end[at]], values[v_end[at - 1] if at else 0 : v_end[at]]
            if which == 2 and k < -1:
                beside.setdefault((int(p[0]) // side // size, int(p[0]) % side // size), []).append((k, p.copy(), v.copy()))
            elif which == 2:
                np.add.at(sums, p, v if len(v) == len(p) else np.full(len(p), v[0]))
            elif which == 1:
                right.append((k, p, v))
            else:
                left.append((k, p, v))
        if right:
            _multiply(sums, side, size, left, right)
        left = [(k, p.copy(), v.copy()) for k, p, v in left if k == keys[-1][3]] if keys else left  # the next batch may have more of the last line's right side
    if cell is not None:
        yield from blocks_of()


def dot(a: DataFrame, b: DataFrame, size: int, *, band: int | None = None, inner: int | None = None, plus: tuple[tuple[float, DataFrame], ...] = (), dealt: bool = True, finish: Finish | None = None, beside: tuple[DataFrame, ...] = (), ddl: str = DDL) -> DataFrame:
    """The product on a grid: a cell of it takes a band of block rows of a and a band of block columns of b, and multiplies inside. plus: signed matrices that are added.

    A band is as wide as SUMS sums allow; a grid of few cells also cuts the inner
    index, and only then sums of blocks are added up after a shuffle. Blocks of a
    line and band travel as one piece, with their cells only, to each cell that
    has a partner for it, which the blocks' indices tell before any cells move:
    with p bands a side each cell of a and b goes to p tasks at most. A task holds the sums
    of its cell and the pieces of a batch; lines with few products for each of their
    cells are multiplied cell by cell, others as dense matrices without empty rows and columns.
    Blocks are never broadcast: Spark takes a mask made by Python for a few KB.

    finish(bi, bj, block, others), if given, makes the rows (ddl) of each block where its sums are whole;
    others has the blocks of the same place of the matrices `beside`, by their number.
    """
    one_task = inner is None
    if band is None or inner is None:
        same = a is b
        a = cut(a) if dealt else a
        b = a if same else cut(b) if dealt else b
        of_a, of_b = (m.agg(F.max("bi") + 1, F.max("bj") + 1).first() for m in (a, b))
        rows, columns, lines = of_a[0] or 1, of_b[1] or 1, min(of_a[1] or 1, of_b[0] or 1)
        for m in [*(m for _, m in plus), *beside]:
            of_m = m.agg(F.max("bi") + 1, F.max("bj") + 1).first()
            rows, columns = max(rows, of_m[0] or 1), max(columns, of_m[1] or 1)
        band = min(max(1, math.isqrt(SUMS) // size), max(rows, columns)) if band is None else band
        if inner is None:
            parts = 1 if finish else max(1, min(-(-lines // INNER), SHARED // (-(-rows // band) * -(-columns // band))))
            inner, one_task = -(-lines // parts), parts == 1
    banded = lambda c, width: F.floor(F.col(c) / width).cast("long")
    columns = b.select(F.col("bi").alias("k"), banded("bj", band).alias("gj")).distinct()
    rows = a.select(F.col("bj").alias("k"), banded("bi", band).alias("gi")).distinct()
    of_a = _pieces(a, size, band, left=True, dealt=dealt).withColumnRenamed("g", "gi").join(columns.hint("shuffle_hash"), "k").withColumn("side", F.lit(0))
    of_b = _pieces(b, size, band, left=False, dealt=dealt).withColumnRenamed("g", "gj").join(rows.hint("shuffle_hash"), "k").withColumn("side", F.lit(1))
    order = ["gi", "gj", "gk", "k", "side"]
    met = of_a.withColumn("gk", banded("k", inner)).select(*order, "p", "v").unionByName(of_b.withColumn("gk", banded("k", inner)).select(*order, "p", "v"))
    for c, m in plus:
        met = met.unionByName(_addends(m, size, band, float(c)).select(*order, "p", "v"))
    for t, m in enumerate(beside):
        met = met.unionByName(_addends(m, size, band, 1.0).withColumn("k", F.lit(-2 - t).cast("long")).select(*order, "p", "v"))
    found = met.repartition(*order[:3]).sortWithinPartitions(*order).mapInArrow(lambda t: _cell_sums(t, band, size, finish), ddl)
    return found if one_task else summed(found, size * size)


def _addends(m: DataFrame, size: int, band: int, c: float) -> DataFrame:
    """The blocks of c m as rows of the grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for bi, bj, x in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), arrays(t.column(2), size * size), strict=True):
                at = np.flatnonzero(x)
                place = ((bi % band) * size + at // size) * (band * size) + (bj % band) * size + at % size
                yield pa.RecordBatch.from_arrays([pa.array([bi // band]), pa.array([bj // band]), pa.array([place.astype(np.int32)]), pa.array([c * x[at]])], ["gi", "gj", "p", "v"])

    rows = m.select("bi", "bj", "x").mapInArrow(run, "gi long, gj long, p array<int>, v array<double>").filter(F.size("p") > 0)
    return rows.select("gi", "gj", F.lit(0).cast("long").alias("gk"), F.lit(-1).cast("long").alias("k"), F.lit(2).alias("side"), "p", "v")


def dot_stored(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """The product of two matrices that are stored in buckets of the inner index (a of bj, b of bi; see sources.blockstore).

    Lines are packed as their buckets have them, sorted, without an exchange of
    blocks; what goes to tasks are pieces of lines, once for each cell of dot's grid that needs them.
    """
    return dot(a, b, size, dealt=False)


def add(size: int, *terms: tuple[float, DataFrame]) -> DataFrame:
    """The sum of signed or scaled matrices."""
    place = lambda i: (F.size("x") != size * size) & (i * 2 < F.size("x"))
    scaled = [m.select("bi", "bj", F.transform("x", lambda v, i: F.when(place(i), v).otherwise(v * F.lit(float(c)))).alias("x")) if c != 1 else m.select("bi", "bj", "x") for c, m in terms]
    out = scaled[0]
    for m in scaled[1:]:
        out = out.unionByName(m)
    return summed(out, size * size)


def transpose(a: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bi, bj, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), arrays(b.column(2), size * size), strict=True):
                yield _batch([(bj, bi, x.reshape(size, size).T)])

    return a.select("bi", "bj", "x").mapInArrow(run, DDL)


def diagonal(spark: SparkSession, n: int, size: int, make: Callable[[int, int], np.ndarray]) -> DataFrame:
    """A block-diagonal n x n matrix; make(b, k) gives the k x k cells of block b as a function of these alone, so a retry makes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                x, k = np.zeros((size, size)), min(size, n - b * size)
                x[:k, :k] = make(b, k)
                yield _batch([(b, b, x)])

    count = -(-n // size)
    return spark.range(0, count, 1, max(1, min(count, spark.sparkContext.defaultParallelism))).mapInArrow(run, DDL)
