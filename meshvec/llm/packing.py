"""Best-two-fit packing of tokenized documents into sequences of a fixed length."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshvec.llm.common import cut

#: Pieces that one packing task holds on average.
SHARD_PIECES = 16384

#: The split pattern of the byte-level BPE vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: tiktoken's split fails at runs of 1,000,000 white-space characters; long before that, texts take the other path.
LONG_RUN = 100_000
SPACES = re.compile(rf"(?<!\s)\s{{{LONG_RUN}}}")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable Latin-1 as it is, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit bytes, equal to those of the tokenizers library for the file."""

    kept: dict[str, Ids] = {}

    def __init__(self, path: str):
        import tiktoken

        letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self.path, self.special, self.exact = path, special, None
        self.encoder = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, path: str) -> Ids:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special) or len(text) >= LONG_RUN and SPACES.search(text):
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.path)
            ids = self.exact.encode(text, add_special_tokens=False).ids
        else:
            ids = self.encoder.encode_ordinary(text)
        return np.asarray(ids, "<u4").tobytes()


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def token_pieces(docs: DataFrame, path: str, *, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32. Ids stay inside the task; only lengths and checksums leave it."""
    end = int(end_id).to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids.of(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = ids(text or "") + end
                n = len(data) // 4
                start, length = 0, n % size or size  # only the first piece may be shorter
                for piece in range((n + size - 1) // size):
                    rows.append((doc, piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
                    start, length = start + length, size
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES, strict=True)], schema=PIECES) if rows else pa.RecordBatch.from_pylist([], schema=PIECES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item.

    A bin takes the largest unpacked item, then again and again the largest
    that fits. If room is left, its smallest item gives way to two unpacked
    ones whose sum fits the widened gap most tightly. Only the counts by length
    matter, kept as bits of an integer, so a step costs O(size / 64).
    """
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    for i in range(len(lengths) - 1, -1, -1):
        stacks[lengths[i]].append(i)
    mask = sum(1 << n for n in range(1, size + 1) if stacks[n])
    turned = sum(1 << (size - n) for n in range(1, size + 1) if stacks[n])  # bit size - n for length n
    bins, offsets = [0] * len(lengths), [0] * len(lengths)

    def take(n: int) -> int:
        nonlocal mask, turned
        i = stacks[n].pop()
        if not stacks[n]:
            mask &= ~(1 << n)
            turned &= ~(1 << (size - n))
        return i

    def give(n: int, i: int) -> None:
        nonlocal mask, turned
        stacks[n].append(i)
        mask |= 1 << n
        turned |= 1 << (size - n)

    def pair(most: int, least: int) -> tuple[int, int] | None:
        """Two lengths of unpacked items with the largest sum in (least, most]."""
        for total in range(most, least, -1):
            hits = mask & (turned >> (size - total)) & ((1 << total) - 1)
            while hits:
                a = hits.bit_length() - 1
                if 2 * a < total:
                    break
                if 2 * a != total or len(stacks[a]) > 1:
                    return a, total - a
                hits &= ~(1 << a)
        return None

    number = 0
    while mask:
        n = mask.bit_length() - 1
        held, gap = [(n, take(n))], size - n
        while gap and (n := (mask & ((2 << gap) - 1)).bit_length() - 1) > 0:
            held.append((n, take(n)))
            gap -= n
        if gap and len(held) > 1 and mask:
            smallest, i = held[-1]
            if found := pair(gap + smallest, smallest):
                held.pop()
                held += [(n, take(n)) for n in found]
                give(smallest, i)
        at = 0
        for n, i in held:
            bins[i], offsets[i] = number, at
            at += n
        number += 1
    return bins, offsets


def pack(pieces: DataFrame, shards: int, *, size: int = 1024) -> DataFrame:
    """Place every piece: its columns, sequence_id and offset.

    Equal rows are counted first, so a document that is repeated without end
    still spreads: its copies are numbered and (id, piece, number) deals them
    over the shards. A shard is packed in one task that holds lengths only.
    """

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("n", "ascending")])
        bins, offsets = best_two_fit(table["length"].to_pylist(), size)
        sequence = (table["shard"].to_numpy().astype("int64") << 32) + np.asarray(bins, "int64")
        return table.select(columns).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets, pa.int64()))

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    counted = pieces.groupBy(*columns).agg(F.count(F.lit(1)).alias("times"))
    numbered = counted.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("n"))
    dealt = numbered.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n"), F.lit(shards)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("shard").applyInArrow(fill, schema)


def pack_documents(docs: DataFrame, path: str, *, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize all documents and pack them into as few sequences of `size` tokens as best-two-fit needs.

    Documents longer than a sequence are cut into full pieces, the first being
    the rest; other documents stay whole. The pieces (numbers only) are
    checkpointed, and their count gives the number of shards, so a task's share
    is the same at every scale, for a few long documents as for many short
    ones. A shard is packed for itself: what doesn't fill its sequences is its
    own loss, which its SHARD_PIECES pieces keep small.

    Defined cases: null text is an empty document of the end id alone; a null
    id stays null; repeated rows are packed as often as they occur; an empty
    table gives an empty result; further columns are not used.
    """
    pieces = cut(token_pieces(docs, path, size=size, end_id=end_id, id_col=id_col, text_col=text_col))
    return pack(pieces, max(1, -(-pieces.count() // SHARD_PIECES)), size=size)
