"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshvec.llm.common import cut, free_name

WORD = re.compile(r"[^\W\d_]+")
#: Terms are words and the beginnings of longer words, hashed to this many bits.
HASH_BITS, PREFIXES = 27, (3, 4, 5)
#: Labelled documents to learn from, at most.
MAX_TRAIN = 20_000
#: A term is kept for what it tells alone from this chi-squared value on.
LEAST_CHI2 = 25.0
#: A pair's terms are kept if the two tell so much more deviance together than each for itself and stand together in so many documents.
LEAST_GAIN, LEAST_CELL = 40.0, 10
#: Tasks that share the terms whose pairs are counted; terms, and meetings of terms, that one of them counts at once.
PAIR_TASKS, CHUNK_TERMS, CHUNK_MEETINGS = 8, 64, 1 << 20
#: Documents that are fitted at once.
SLICE = 2048


def word_terms(word: str) -> set[int]:
    mask = (1 << HASH_BITS) - 1
    return {zlib.crc32(f"w {word}".encode()) & mask} | {zlib.crc32(f"p {word[:n]}".encode()) & mask for n in PREFIXES if len(word) >= n}


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class FactorizationMachine:
    """bias + sum of weights + the pairwise products of factors, over the kept terms that a text has."""

    terms: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    known: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def active(self, text: str | None) -> list[int]:
        known, found = self.known, set()
        words = words_of(text)
        for w in words:
            hit = known.get(w)
            if hit is None:
                if len(known) > 500_000:
                    known.clear()
                hit = known[w] = tuple(sorted({self.terms[t] for t in word_terms(w) if t in self.terms}))
            if hit:
                found.update(hit)
        return sorted(found)

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        """The probabilities of a batch of texts: sums by text over the terms that it has."""
        on = [self.active(t) for t in texts]
        n, at = len(on), np.array([i for x in on for i in x], np.int64)
        text = np.repeat(np.arange(n), [len(x) for x in on])
        total = lambda values: np.bincount(text, values[at], n)
        pairs = sum((total(f) ** 2 for f in self.factors.T), np.zeros(n)) - total((self.factors**2).sum(1))
        z = self.bias + total(self.weights) + 0.5 * pairs
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def surprise(hit: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The largest log likelihood of so many hits among so many."""
    hit, count = np.asarray(hit, float), np.asarray(count, float)
    miss = count - hit
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(hit > 0, hit * np.log(hit / count), 0.0) + np.where(miss > 0, miss * np.log(miss / count), 0.0)


def gain(both: np.ndarray, both_hit: np.ndarray, a: np.ndarray, a_hit: np.ndarray, b: np.ndarray, b_hit: np.ndarray, n: int, pos: int) -> np.ndarray:
    """Deviance of the label by the four cells of two terms, less that by each alone.

    It is about 0 for terms that tell by themselves only, and large where the
    label depends on both, however little either tells alone.
    """
    cells = surprise(both_hit, both) + surprise(a_hit - both_hit, a - both) + surprise(b_hit - both_hit, b - both) + surprise(pos - a_hit - b_hit + both_hit, n - a - b + both)
    alone = surprise(a_hit, a) + surprise(pos - a_hit, n - a) + surprise(b_hit, b) + surprise(pos - b_hit, n - b)
    return 2 * (cells - alone + surprise(pos, n))


def interacting(y: np.ndarray, flat: np.ndarray, sizes: np.ndarray, terms: int, part: int, parts: int) -> list[tuple[int, int, float]]:
    """(a, b, gain) of interacting pairs, a being one of the part's terms (a % parts = part) and b a later one.

    Documents are rows of the sparse matrix (flat, sizes), with the places of
    their terms, which rise with the terms' frequency, in order. Every pair of
    terms that a document has is counted, a chunk of terms a at a time; none is
    left out. Of pairs that gain on the same documents the one with most stays:
    going down by gain, a pair is kept if b still splits the documents of a that
    no kept pair accounts for.
    """
    n, pos = len(y), int(y.sum())
    ends = np.cumsum(sizes).astype(np.int32)
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)
    order = np.argsort(flat, kind="stable").astype(np.int32)
    seen, hits = np.bincount(flat, minlength=terms), np.bincount(flat[(y == 1)[row]], minlength=terms)
    starts = np.r_[0, np.cumsum(seen)]
    meets = np.zeros(terms)  # how many terms stand behind each one in its documents
    for at in range(0, len(flat), CHUNK_MEETINGS):
        some = slice(at, at + CHUNK_MEETINGS)
        meets += np.bincount(flat[some], weights=ends[row[some]] - 1 - np.arange(at, at + len(flat[some])), minlength=terms)
    found: list[np.ndarray] = []
    own = np.arange(part, terms, parts)
    meets = meets[own]
    at = 0
    while at < len(own):
        room = np.searchsorted(np.cumsum(meets[at : at + CHUNK_TERMS]), CHUNK_MEETINGS) + 1
        mine = own[at : at + min(room, CHUNK_TERMS)]
        at += len(mine)
        entries = np.concatenate([order[starts[a] : starts[a + 1]] for a in mine])
        local = np.repeat(np.arange(len(mine)), seen[mine])
        many = ends[row[entries]] - entries - 1
        first = np.cumsum(many) - many
        others = flat[np.arange(many.sum()) - np.repeat(first - entries - 1, many)]
        keys = np.repeat(local * terms, many) + others
        both = np.bincount(keys, minlength=len(mine) * terms)
        both_hit = np.bincount(keys[np.repeat(y[row[entries]] == 1, many)], minlength=len(mine) * terms)
        met = np.flatnonzero(both >= LEAST_CELL)
        a, b = mine[met // terms], met % terms
        g = gain(both[met], both_hit[met], seen[a], hits[a], seen[b], hits[b], n, pos)
        good = g >= LEAST_GAIN
        found.append(np.stack([a[good], b[good], g[good]], 1))
    pairs = np.concatenate(found) if found else np.zeros((0, 3))
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0], -pairs[:, 2]))]
    free, out = np.ones(n, bool), []
    docs_of = lambda t: row[order[starts[t] : starts[t + 1]]]
    for a, b, g in pairs.tolist():
        left = docs_of(int(a))
        left = left[free[left]]
        if -2 * surprise(y[left].sum(), len(left)) < LEAST_GAIN:
            continue
        with_b = np.isin(left, docs_of(int(b)), assume_unique=True)
        split = surprise(y[left][with_b].sum(), with_b.sum()) + surprise(y[left][~with_b].sum(), (~with_b).sum()) - surprise(y[left].sum(), len(left))
        if 2 * split >= LEAST_GAIN:
            out.append((int(a), int(b), g))
            free[left] = False
    return out


def interactions(sample: DataFrame, place: dict[int, int]) -> DataFrame:
    """a, b, gain of the interacting pairs of terms (by their places), counted in PAIR_TASKS tasks. A task holds the sample's documents with those of their terms that have a place."""
    terms = len(place)

    def screen(table: pa.Table) -> pa.Table:
        y, part, on = table["y"].to_numpy(), table["part"][0].as_py(), table["on"].combine_chunks()
        found = interacting(y, on.flatten().to_numpy(zero_copy_only=False), on.value_lengths().to_numpy(zero_copy_only=False), terms, part, PAIR_TASKS)
        return pa.table({"a": pa.array([x[0] for x in found], pa.int32()), "b": pa.array([x[1] for x in found], pa.int32()), "gain": pa.array([x[2] for x in found], pa.float64())})

    copies = _placed(sample, place).withColumn("part", F.explode(F.array(*[F.lit(k) for k in range(PAIR_TASKS)])))
    return copies.groupBy("part").applyInArrow(screen, "a int, b int, gain double")


def _placed(sample: DataFrame, place: dict[int, int]) -> DataFrame:
    """id, y, on: the sorted places of each document's terms."""

    def places(terms: pd.Series) -> pd.Series:
        return terms.map(lambda ts: sorted({place[t] for t in ts.tolist() if t in place}))

    return sample.select("id", "y", F.pandas_udf(places, "array<int>")("terms").alias("on"))


def fit(x: np.ndarray, y: np.ndarray, *, factors: int = 8, rounds: int = 250, rate: float = 0.03, l2: float = 1e-3, seed: int = 5) -> tuple[float, np.ndarray, np.ndarray]:
    """Full-batch Adam on the logistic loss; both classes weigh the same. x: 0/1 matrix of bytes, documents by terms, read SLICE rows at a time."""
    rng = np.random.default_rng(seed)
    n, k = x.shape
    params = [np.zeros(1, np.float32), np.zeros(k, np.float32), rng.normal(0, 0.01, (k, factors)).astype(np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    pos = max(1, int(y.sum()))
    weight = np.where(y == 1, 0.5 / pos, 0.5 / max(1, n - pos)).astype(np.float32)
    for step in range(1, rounds + 1):
        b, w, v = params
        total, gx, gv = 0.0, np.zeros(k, np.float32), np.zeros((k, factors), np.float32)
        for at in range(0, n, SLICE):
            part = x[at : at + SLICE].astype(np.float32)
            xv = part @ v
            z = b[0] + part @ w + 0.5 * ((xv**2).sum(1) - part @ (v**2).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at : at + SLICE]) * weight[at : at + SLICE]
            total += float(g.sum())
            gx += part.T @ g
            gv += part.T @ (g[:, None] * xv)
        grads = [np.array([total], np.float32), gx + l2 * w / k, gv - v * gx[:, None] + l2 * v / k]
        for p, grad, (m, s) in zip(params, grads, moments, strict=True):
            m += 0.1 * (grad - m)
            s += 0.001 * (grad**2 - s)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-9)
    return float(params[0][0]), params[1], params[2]


def train_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> FactorizationMachine:
    """Learn from the documents whose label row satisfies `learn`, at most max_train of them (the smallest hashes of ids).

    Terms are counted in Spark. The machine gets those that tell by themselves
    (chi-squared of LEAST_CHI2 or more), and those of pairs that tell together
    what neither does alone: all pairs are counted of terms that stand in
    LEAST_CELL documents or more and whose own documents a perfect split could
    gain LEAST_GAIN on. Neither terms nor pairs have a cap. What reaches the
    driver follows max_train: the terms that may pair or tell, and, for each
    text, which of the kept ones it has. Of rows with one id, one is learned
    from. If one class is missing, the machine has no terms and scores the
    share of toxic labels.
    """
    rows = labels.filter(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    picked = rows.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_train)
    # at most max_train pairs of numbers are broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select(F.col("id").cast("long"), "y", "text")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set().union(*map(word_terms, words_of(text)))) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["id", "y", "terms"])

    found = texts.mapInArrow(terms, "id long, y int, terms array<int>").groupBy("id", "y").agg(F.min_by("terms", F.xxhash64("terms")).alias("terms"))
    sample = cut(found)
    n, pos = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    none = FactorizationMachine({}, float(np.log((pos + 1) / (n - pos + 1))), np.zeros(0), np.zeros((0, 1)))
    if pos in (0, n):
        return none
    # documents whose terms are all the same, and whose label is, tell a pair nothing more than one of them does
    once = sample.groupBy("y", "terms").agg(F.min("id").alias("id"))
    counts = sample.select("y", F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("all"), F.sum("y").alias("hit"))
    a, b = F.col("hit").cast("double"), (F.col("all") - F.col("hit")).cast("double")
    c, d = F.lit(float(pos)) - a, F.lit(float(n - pos)) - b
    chi2 = F.lit(float(n)) * (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d) * F.lit(float(pos)) * F.lit(float(n - pos)))
    impure = -2 * sum((F.when(x > 0, x * F.log(x / (a + b))).otherwise(0.0) for x in (a, b)), F.lit(0.0))
    pairs = (F.col("all") >= LEAST_CELL) & (F.lit(n) - F.col("all") >= LEAST_CELL) & (impure >= LEAST_GAIN)
    told = counts.filter(F.col("all") >= 3).select("t", "all", ((c + d > 0) & (F.col("hit") >= 3) & (chi2 >= LEAST_CHI2)).alias("tells"), pairs.alias("pairs"))
    known = told.filter("tells or pairs").orderBy("all", "t").toArrow()
    names, tells, tried = (known[x].to_numpy(zero_copy_only=False) for x in ("t", "tells", "pairs"))
    found = interactions(once, {int(t): i for i, t in enumerate(names[tried])}).toArrow()
    paired = names[tried][np.unique(np.r_[found["a"].to_numpy(), found["b"].to_numpy()])]
    chosen = np.unique(np.r_[names[tells], paired]).tolist()
    if not chosen:
        return none
    kept = _placed(sample, {int(t): i for i, t in enumerate(chosen)}).toArrow().sort_by("id")
    y, on = kept["y"].to_numpy().astype(np.float32), kept["on"].combine_chunks()
    x = np.zeros((len(y), len(chosen)), np.uint8)  # a byte for each document and term
    x[np.repeat(np.arange(len(y)), on.value_lengths().to_numpy(zero_copy_only=False)), on.flatten().to_numpy(zero_copy_only=False)] = 1
    del kept, on
    bias, weights, factors = fit(x, y)
    return FactorizationMachine({int(t): k for k, t in enumerate(chosen)}, bias, weights, factors)


def toxicity(text: Column, model: FactorizationMachine) -> Column:
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts), dtype="float64")

    return F.pandas_udf(scores, "double")(text)


def score_toxicity(docs: DataFrame, model: FactorizationMachine, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the probability of a toxic label, from the text alone.

    Defined cases: null and empty texts have no terms and score the bias;
    repeated rows score alike; if docs has the score column already, the new
    one gets leading underscores; an empty table gives an empty result.
    """
    return docs.withColumn(free_name(docs, score_col), toxicity(F.col(text_col), model))


def drop_toxic(docs: DataFrame, model: FactorizationMachine, *, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs without those whose score reaches the threshold."""
    return docs.filter(toxicity(F.col(text_col), model) < threshold)
