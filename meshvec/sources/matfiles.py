"""Networks in MATLAB files of level 5, as coordinates."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the file format: number types, kinds of elements, the class of sparse arrays and those of full numeric ones.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED, SPARSE, FULL = 14, 15, 5, range(6, 16)
HEADER = 128


#: Cells that a task turns into coordinates at once, and bytes that are inflated at once.
CELLS, INFLATED = 262_144, 1 << 20
#: A piece of a matrix: its place, 0 for row numbers, 1 for values with (column, cells) runs, 2 for values of a full array whose first cell and number of rows are given.
PIECES = "file string, piece long, role int, form string, runs binary, data binary"


class Body:
    """The bytes of a data element from its start to its end; those of a deflated one are inflated as they are asked for."""

    def __init__(self, data: memoryview, deflated: bool) -> None:
        self.data, self.at, self.inflate = data, 0, zlib.decompressobj() if deflated else None

    def take(self, n: int) -> bytes:
        if self.inflate is None:
            self.at += n
            got = bytes(self.data[self.at - n : self.at])
        else:
            parts, left = [], n
            while left:
                fed = self.inflate.unconsumed_tail
                if not fed:
                    fed = self.data[self.at : self.at + INFLATED]
                    self.at += len(fed)
                some = self.inflate.decompress(fed, left)
                if not some and not len(fed):
                    break
                parts.append(some)
                left -= len(some)
            got = b"".join(parts)
        if len(got) < n:
            raise ValueError("the file ends inside a matrix")
        return got

    def tag(self, order: str) -> tuple[int, int, bytes | None]:
        """Kind and size of the next element, and its content if it has the short form of up to four bytes."""
        head = self.take(8)
        kind, size = (int(x) for x in np.frombuffer(head, f"{order}u4"))
        return (kind & 0xFFFF, kind >> 16, head[4 : 4 + (kind >> 16)]) if kind >> 16 else (kind, size, None)

    def numbers(self, order: str, each: int | None = None) -> Iterator[np.ndarray]:
        """The numbers of the next element, `each` at a time or all at once, and past its padding."""
        kind, size, short = self.tag(order)
        form = np.dtype(order + NUMBERS[kind])
        if short is not None:
            yield np.frombuffer(short, form)
            return
        step, left = size if each is None else each * form.itemsize, size
        while left:
            some = min(step, left)
            yield np.frombuffer(self.take(some), form)
            left -= some
        self.take(-size % 8)


def matrices(content: bytes) -> Iterator[tuple[Body, str]]:
    """The body of each matrix of a file, with its byte order."""
    data, order, at = memoryview(content), "<" if content[126:128] == b"IM" else ">", HEADER
    while at + 8 <= len(data):
        kind, size = (int(x) for x in np.frombuffer(data, f"{order}u4", 2, at))
        if kind >> 16:
            at += 8
            continue
        deflated = kind == COMPRESSED  # such elements have no padding
        body = Body(data[at + 8 : at + 8 + size], deflated)
        if (body.tag(order)[0] if deflated else kind) == MATRIX:
            yield body, order
        at += 8 + size + (0 if deflated else -size % 8)


def pieces(content: bytes, name: str) -> Iterator[tuple[int, int, str, bytes, bytes]]:
    """The matrix called name in pieces of CELLS cells (piece, role, form, runs, data); ValueError if the file has none or ends inside it."""
    for body, order in matrices(content):
        flags, shape = (np.concatenate(list(body.numbers(order))) for _ in range(2))
        called = b"".join(x.tobytes() for x in body.numbers(order)).decode("latin-1")
        form = int(flags.view(f"{order}u4")[0]) & 0xFF
        if called != name or form != SPARSE and form not in FULL:
            continue
        if form != SPARSE:
            for at, v in enumerate(body.numbers(order, CELLS)):
                yield at, 2, v.dtype.str, np.array([at * CELLS, shape[0]], np.int64).tobytes(), v.tobytes()
            return
        for at, i in enumerate(body.numbers(order, CELLS)):
            yield at, 0, i.dtype.str, b"", i.tobytes()
        starts = np.concatenate(list(body.numbers(order))).astype(np.int64)[: int(shape[1]) + 1]
        last = int(starts[-1])
        for at, v in enumerate(body.numbers(order, CELLS)):
            first = at * CELLS
            v = v[: max(0, last - first)]
            if not len(v):
                return
            lo, hi = (int(np.searchsorted(starts, x, "right")) - 1 for x in (first, first + len(v) - 1))
            cells = np.diff(np.clip(starts[lo : hi + 2], first, first + len(v)))
            held = np.flatnonzero(cells)
            yield at, 1, v.dtype.str, np.concatenate([held + lo, cells[held]]).astype(np.int64).tobytes(), v.tobytes()
        return
    raise ValueError(f"no matrix {name}")


def _coordinates(table: pa.Table) -> pa.Table:
    """i, j, v of a piece, without zeros."""
    of = {r["role"]: (np.frombuffer(r["data"], r["form"]), np.frombuffer(r["runs"], np.int64)) for r in table.to_pylist()}
    if 2 in of:
        v, (first, rows) = of[2]
        at = first + np.arange(len(v))
        i, j = at % rows, at // rows
    elif 1 in of:
        v, runs = of[1]
        i, j = of[0][0][: len(v)], np.repeat(*runs.reshape(2, -1))
    else:  # room for more cells than there are
        i = j = v = np.array([], np.int64)
    kept = v != 0
    return pa.table({"i": pa.array(i[kept].astype(np.int64)), "j": pa.array(j[kept].astype(np.int64)), "v": pa.array(v[kept].astype(float))})


def read_network(spark: SparkSession, path: str, name: str = "network") -> DataFrame:
    """i, j, v of the matrix called name in a file, or in each file of a folder, by Spark's reader, so from any store that it knows.

    A deflated matrix can only be read from its start. One task of each file
    inflates it bit by bit and cuts its row numbers and values into pieces of
    CELLS cells; beside the file it holds the starts of the columns and one
    piece. Row numbers and values of a piece meet in a shuffle, after which all
    tasks make coordinates. A file has at most 2 GB, Spark's bound on a value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for one in pieces(content.as_py(), name):
                    yield pa.RecordBatch.from_pylist([dict(zip(("file", "piece", "role", "form", "runs", "data"), (file, *one), strict=True))], schema=schema)

    schema = pa.schema([("file", pa.string()), ("piece", pa.int64()), ("role", pa.int32()), ("form", pa.string()), ("runs", pa.binary()), ("data", pa.binary())])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, PIECES).groupBy("file", "piece").applyInArrow(_coordinates, "i long, j long, v double")
