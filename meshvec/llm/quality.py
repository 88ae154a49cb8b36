"""Quality by a generalised additive model with pairwise interactions, boosted in cycles."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshvec.llm.common import free_name

#: Labelled documents to learn from, at most.
MAX_TRAIN = 20_000
FEATURES = (
    "log_chars", "word_length", "upper", "symbols", "marks", "digits", "stops", "spaces", "other_bytes", "entropy",
    "distinct_words", "top_word", "repeated_words", "distinct_pairs", "distinct_lines", "words_a_line", "ended_lines", "short_words", "long_words", "wordlike",
)


def _class(chars: str) -> np.ndarray:
    found = np.zeros(256, np.int64)
    found[[ord(c) for c in chars]] = 1
    return found


UPPER, LOWER, DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz"), _class("0123456789")
BLANK, SYMBOL, MARK = _class(" \t\n\r\x0b\x0c"), _class("#$%&*+/<=>@[\\]^_`{|}~"), _class("!\"'(),-.:;?")


def text_features(text: str | None) -> list[float]:
    """The numbers that the model sees, all of the whole text; an empty text has zeros."""
    text = text or ""
    words = text.split()
    if not words:
        return [float(np.log1p(len(text)))] + [0.0] * (len(FEATURES) - 1)
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n, size = len(words), float(counts.sum())
    upper, lower = float(counts @ UPPER), float(counts @ LOWER)
    by_word = Counter(words)
    repeated = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    p = counts[counts > 0] / size
    lengths = list(map(len, words))
    return [
        float(np.log1p(len(text))), sum(lengths) / n, upper / max(1.0, upper + lower), float(counts @ SYMBOL) / size, float(counts @ MARK) / n,
        float(counts @ DIGIT) / size, float(counts[ord(".")] + counts[ord("?")]) / n, float(counts @ BLANK) / size, float(counts[128:].sum()) / size, -float(p @ np.log2(p)),
        len(by_word) / n, max(by_word.values()) / n, repeated / n, len(set(zip(words, words[1:]))) / n, len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)),
        sum(x.rstrip().endswith((".", "!", "?", ":", "\"")) for x in lines) / max(1, len(lines)), sum(k <= 3 for k in lengths) / n, sum(k > 20 for k in lengths) / n, sum(map(str.isalpha, words)) / n,
    ]


@dataclass
class AdditiveModel:
    """Cuts and a lookup table for each feature, and a table for each chosen pair of features (on its coarse cuts)."""

    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sums of table entries; x: rows by features."""
        total = np.full(len(x), self.bias)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, j], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _best_cut(grad: np.ndarray, hess: np.ndarray, l2: float) -> tuple[float, int]:
    """Gain and place of the best split of bins into two runs."""
    g, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
    gt, ht = grad.sum(), hess.sum()
    gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """A shallow regression tree over the bins of one feature, as the value of each bin."""
    runs = [(0, len(grad))]
    while len(runs) < leaves:
        found = [(_best_cut(grad[a:b], hess[a:b], l2), a, b) for a, b in runs if b - a > 1]
        if not found:
            break
        (gain, at), a, b = max(found, key=lambda x: x[0][0])
        if gain <= 1e-12:
            break
        runs.remove((a, b))
        runs += [(a, a + at), (a + at, b)]
    out = np.zeros(len(grad))
    for a, b in runs:
        out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + l2)
    return out


def _pair_tree(grad: np.ndarray, hess: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """One cut on each of two features: four leaves. Gain and the value of each cell."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    gt, ht = g[-1, -1], h[-1, -1]
    best, out = -1.0, np.zeros_like(grad)
    parts = lambda m, t: (m[:-1, :-1], m[:-1, -1:] - m[:-1, :-1], m[-1:, :-1] - m[:-1, :-1], t - m[:-1, -1:] - m[-1:, :-1] + m[:-1, :-1])
    if min(grad.shape) < 2:
        return best, out
    gs, hs = parts(g, gt), parts(h, ht)
    gain = sum(a**2 / (b + l2) for a, b in zip(gs, hs, strict=True)) - gt**2 / (ht + l2)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = [a[i, j] / (b[i, j] + l2) for a, b in zip(gs, hs, strict=True)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 64, coarse_bins: int = 12, cycles: int = 120, leaves: int = 4, rate: float = 0.15, pairs: int = 6, pair_cycles: int = 40, l2: float = 2.0) -> AdditiveModel:
    """Cyclic boosting: each round gives every feature one shallow tree on what is left; then the pairs that gain most get theirs."""
    n, width = x.shape
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    quantiles = lambda v, k: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1]))
    cuts = [quantiles(x[:, j], bins) for j in range(width)]
    coarse = [quantiles(x[:, j], coarse_bins) for j in range(width)]
    model = AdditiveModel(float(np.log(share / (1 - share))), cuts, [np.zeros(len(c) + 1) for c in cuts], coarse, [], [])
    at = [np.searchsorted(cuts[j], x[:, j], side="right") for j in range(width)]
    rough = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(width)]
    z = np.full(n, model.bias)
    for _ in range(cycles):
        for j in range(width):
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            k = len(cuts[j]) + 1
            step = rate * _tree(np.bincount(at[j], y - p, k), np.bincount(at[j], p * (1 - p), k), leaves, l2)
            model.tables[j] += step
            z += step[at[j]]

    def grids(i: int, j: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        cell = rough[i] * shape[1] + rough[j]
        return np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    gains = sorted(((_pair_tree(*grids(i, j, p), l2)[0], i, j) for i in range(width) for j in range(i + 1, width)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(pair_cycles):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            step = rate * _pair_tree(*grids(i, j, p), l2)[1]
            table += step
            z += step[rough[i], rough[j]]
    return model


def _features(texts: pd.Series) -> np.ndarray:
    return np.array([text_features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


def train_quality(docs: DataFrame, labels: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> AdditiveModel:
    """Learn from the documents whose label row satisfies `learn`, at most max_train of them (the smallest hashes of ids).

    The driver gets the features of those texts, not the texts. Of rows with
    one id, one is learned from. Without labelled rows, the model scores one
    half.
    """
    rows = labels.filter(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    picked = rows.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_train)
    # at most max_train pairs of numbers are broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")

    def features(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_features(texts)))

    found = texts.select("id", "y", F.pandas_udf(features, "array<double>")("text").alias("x"), F.xxhash64("text").alias("h"))
    got = found.groupBy("id", "y").agg(F.min_by("x", "h").alias("x")).toPandas().sort_values("id", kind="stable")
    if got.empty:
        none = [np.zeros(0) for _ in FEATURES]
        return AdditiveModel(0.0, none, [np.zeros(1) for _ in FEATURES], none, [], [])
    return fit(np.stack(got["x"].to_list()), got["y"].to_numpy(np.float64))


def quality(text: Column, model: AdditiveModel) -> Column:
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_features(texts)))

    return F.pandas_udf(scores, "double")(text)


def score_quality(docs: DataFrame, model: AdditiveModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the probability of a good label, from the text alone.

    Defined cases: null and empty texts have features of zero; repeated rows
    score alike; if docs has the score column already, the new one gets leading
    underscores; an empty table gives an empty result.
    """
    return docs.withColumn(free_name(docs, score_col), quality(F.col(text_col), model))
