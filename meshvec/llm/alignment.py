"""Alignment of two tokenizations of each text by elementary intervals, with counts of aligned pairs over all texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshvec.llm.common import cut, settle
from meshvec.llm.packing import LONG_RUN, SPACES, Ids

#: A pair is hot if it has one in HOT_SHARE or more of all links, so no more than HOT_SHARE are.
HOT_SHARE = 100_000
#: Texts and bytes of results that go back to Spark at once.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"
NAMES = [c.split()[0] for c in ALIGNED.split(", ")]
KINDS = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each elementary interval: its owners in A and in B, and whether A, B, and both end with it.

    Both arrays grow and end at the same place. The union of all ends cuts the
    text into intervals. One lies inside one token of either side, and two
    tokens that overlap share exactly one, since no end falls inside their
    intersection. Ends are marked by byte, so nothing is sorted or searched.
    """
    marks = np.zeros(int(a_ends[-1]) + 1, np.uint8)
    marks[a_ends] = 1
    marks[b_ends] |= 2
    marks = marks[marks > 0]
    a_stops, b_stops = (marks & 1).astype(bool), marks > 1
    return np.cumsum(a_stops) - a_stops, np.cumsum(b_stops) - b_stops, a_stops, b_stops, marks == 3


class Vocabulary:
    """Bytes and byte lengths of tokens by id, and ids as text with the mark that follows."""

    def __init__(self, tokens: list[bytes], last: str):
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.names = np.array([f"{i}," for i in range(len(tokens))], object)
        self.last = np.array([f"{i}{last}" for i in range(len(tokens))], object)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens one after another."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.data[np.repeat(self.starts[ids] - ends + n, n) + np.arange(ends[-1] if len(ids) else 0)]


class Aligner:
    """Encodes texts by a byte-level vocabulary (A) and a sentence-piece model (B), which puts a space before each text."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor

        self.ids, self.exact = Ids.of(a_path), None
        ranks = {i: t for t, i in self.ids.encoder._mergeable_ranks.items()}
        self.a = Vocabulary([ranks.get(i, b"") for i in range(max(ranks) + 1)], "|")
        self.pieces = SentencePieceProcessor(model_file=b_path)
        size = self.pieces.get_piece_size()
        self.b = Vocabulary([self._bytes(i) for i in range(size)], ";")

    def _bytes(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        if self.pieces.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode_a(self, text: str) -> np.ndarray:
        """Ids of a text, special tokens' strings being plain text."""
        if len(text) < LONG_RUN or not SPACES.search(text):
            return np.asarray(self.ids.encoder.encode_to_numpy(text, disallowed_special=()), np.int64)
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.ids.path)
            self.exact.encode_special_tokens = True
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, np.int64)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, or None if either doesn't give back a space and the text."""
        whole = f" {text}"
        a, b, data = self.encode_a(whole), np.array(self.pieces.encode(text), np.int64), np.frombuffer(whole.encode(), np.uint8)
        return (a, b) if np.array_equal(self.a.joined(a), data) and np.array_equal(self.b.joined(b), data) else None

    def align(self, text: str | None) -> tuple:
        """n_a, n_b, n_groups, n_links, groups, pairs, times of a text."""
        found = self.encode(text) if text else None
        if found is None:
            return 0, 0, 0, 0, "", (), ()
        a, b = found
        a_ends, b_ends = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        in_a, in_b, a_stops, b_stops, shared = found = overlaps(a_ends, b_ends)
        pairs, times = np.unique(a[in_a] * len(self.b.lengths) + b[in_b], return_counts=True)
        return len(a), len(b), int(shared.sum()), len(in_a), self._groups(a, b, *found), pairs, times

    def _groups(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, a_stops: np.ndarray, b_stops: np.ndarray, shared: np.ndarray) -> str:
        """`a1,a2|b1;a3|b2,b3`: the ids of each group, put at their places in one array of words."""
        a_to, b_to, group = in_a[shared] + 1, in_b[shared] + 1, np.cumsum(shared) - shared  # tokens up to the end of each group; the group of each interval
        at_a = np.arange(len(a)) + np.r_[0, b_to[:-1]][group[a_stops]]
        at_b = np.arange(len(b)) + a_to[group[b_stops]]
        words = np.empty(len(a) + len(b), object)
        words[at_a], words[at_b] = self.a.names[a], self.b.names[b]
        words[at_a[a_to - 1]], words[at_b[b_to - 1]] = self.a.last[a[a_to - 1]], self.b.last[b[b_to - 1]]
        return "".join(words.tolist())[:-1]


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each Python worker."""
    return Aligner(a_path, b_path)


def align_texts(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times of every text.

    A encodes a space and the text, B the text (and adds the space itself).
    Groups are what byte offsets at which tokens of both end cut the tokens
    into. A link is a pair of token occurrences whose byte ranges overlap;
    pairs has the different id pairs of all links as a * size of B + b, times
    how many links each has. Memory follows the longest text, time all texts.

    Defined cases: null and empty texts, and texts that either side doesn't
    give back byte by byte, have no tokens: zeros, an empty groups and empty
    arrays; a null id stays null; repeated rows have equal results; an empty
    table gives an empty result; further columns are not used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append((doc, *own.align(text)))
                size += len(rows[-1][5]) + 16 * len(rows[-1][6])
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ALIGNED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    lists = []
    for k in (6, 7):
        ends = np.cumsum([0, *map(len, columns[k])])
        flat = np.concatenate([np.asarray(x, np.int64) for x in columns[k]])
        lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns[:6], KINDS, strict=False)), *lists], NAMES)


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """pair, n (its links over all texts), best (no pair with its B id has more): added up inside tasks before the shuffle."""
    single = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = cut(single.groupBy("pair").agg(F.sum("times").alias("n")))
    tops = counts.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("n").alias("top"))
    # a row for each id of B at most, so it may be broadcast
    return counts.withColumn("b", F.col("pair") % b_size).join(F.broadcast(tops), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def link_sums(aligned: DataFrame, facts: DataFrame) -> DataFrame:
    """row, n_best, count_sum: each text's links by the counts of their pairs; aligned: row, pairs, times.

    Most links are of few pairs: hot ones, HOT_SHARE rows at most, are
    broadcast and added up where the texts lie. Only the others are shuffled by
    pair, and none of those has one in HOT_SHARE of all links.
    """
    total = facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") * HOT_SHARE >= total
    single = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    near = single.join(F.broadcast(facts.filter(hot)), "pair", "left")
    told = lambda rows: rows.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    far = single.join(F.broadcast(facts.filter(hot).select("pair")), "pair", "left_anti").join(facts.filter(~hot), "pair")
    sums = told(near.filter("n is not null")).unionByName(told(far))
    return sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def cross_tokenizer_alignment(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every text.

    n_best counts the links whose pair is, over all texts, the most frequent
    one with its B id, ties included; count_sum adds up the counts of all
    links. Texts are encoded once: numbers, digests and pairs are settled, and
    counts and sums come from that table.

    Defined cases: those of align_texts; groups_sha256 is empty where a text
    has no tokens; rows are told apart by a number of their own, so repeated
    rows and null ids have a result each.
    """
    from sentencepiece import SentencePieceProcessor

    b_size = SentencePieceProcessor(model_file=b_path).get_piece_size()
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    found = align_texts(docs, a_path, b_path, id_col=id_col, text_col=text_col)
    aligned = settle(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"))
    sums = link_sums(aligned.select("row", "pairs", "times"), cut(pair_counts(aligned, b_size)))
    filled = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return aligned.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *filled, "groups_sha256")
