"""Multi-label node classification with a known number of labels, and matrix errors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshvec.functions.columns import mix_key
from meshvec.functions.lineage import cut, global_rank
from meshvec.operators import blocks


def labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes with one label or more."""
    return nodes.join(labels.select("node").distinct(), "node", "left_semi")


def split_prefix(nodes: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """node, train: the first floor(fraction * n) nodes of a mixed order train."""
    ranked = global_rank(nodes.select("node", mix_key(F.col("node"), F.lit(seed)).alias("key")), ["key", "node"])
    return ranked.select("node", (F.col("rank") <= F.floor(F.lit(fraction) * F.col("n"))).alias("train"))


def topk(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """node, label of the k best scores of each node, k being its number of true labels; ties go to the smaller label."""
    k = truth.groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    best = Window.partitionBy("node").orderBy(F.desc("p"), "label")
    return scores.withColumn("r", F.row_number().over(best)).join(k, "node").filter("r <= k").select("node", "label")


def confusion(predicted: DataFrame, truth: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """label, tp, fp, fn. times (node, rows): how often each node counts, once if not given."""
    both = predicted.select("node", "label", F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(truth.select("node", "label", F.lit(0).alias("p"), F.lit(1).alias("t")))
    cells = both.groupBy("node", "label").agg(F.max("p").alias("p"), F.max("t").alias("t"))
    cells = cells.withColumn("rows", F.lit(1)) if times is None else cells.join(times, "node")
    p, t, n = F.col("p"), F.col("t"), F.col("rows")
    return cells.groupBy("label").agg(F.sum(p * t * n).alias("tp"), F.sum(p * (1 - t) * n).alias("fp"), F.sum((1 - p) * t * n).alias("fn"))


def micro_f1(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum(F.col("tp") * 2) / F.nullif(F.sum(F.col("tp") * 2 + F.col("fp") + F.col("fn")), F.lit(0)), F.lit(0.0)).alias("micro_f1"))


def macro_f1(counts: DataFrame) -> DataFrame:
    """The mean of the labels' F1, 0 where a label is neither true nor predicted."""
    f1 = F.coalesce(F.col("tp") * 2 / F.nullif(F.col("tp") * 2 + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    return counts.agg(F.coalesce(F.avg(f1), F.lit(0.0)).alias("macro_f1"))


#: Numbers that a pass over the rows sums up at once, and weights that are held at once.
PASS_NUMBERS = 4_000_000
#: Rows that a task works on at once, and cells (rows x models) of them.
SLICE, CELLS = 1024, 1_000_000
#: Numbers in a row that carries a part of a sum.
CARRIED = 32_768


def _slices(batches: Iterator[pa.RecordBatch], d: int, names: np.ndarray, models: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """node, vectors with a 1 at the end, which labels of names (sorted) a row has, its flags and its number of labels, by slices of rows (node, vec, labels, flags)."""
    most = max(1, min(SLICE, CELLS // max(1, models)))
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            n = part.num_rows
            x = np.ones((n, d + 1))
            x[:, :d] = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, d)
            k = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
            label = part.column(2).flatten().to_numpy(zero_copy_only=False)
            y = np.zeros((n, len(names)), bool)
            if len(names):
                place = np.minimum(np.searchsorted(names, label), len(names) - 1)
                known = names[place] == label
                y[np.repeat(np.arange(n), k)[known], place[known]] = True
            yield part.column(0).to_pylist(), x, y, part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(n, -1), k


def _summed(rows: DataFrame, d: int, names: np.ndarray, models: int, width: int, add: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """A pass over all rows: what add(out, x, y, flags) adds up for each model, an array (models, width). Sums go from task to task in rows of several models.

    flags say which splits learn from a row, or how many rows like it they learn from.
    """
    each = max(1, CARRIED // width)
    parts = -(-models // each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((parts * each, width))
        for _, x, y, flags, _ in _slices(batches, d, names, models):
            add(out[:models], x, y, flags)
        for at, some in enumerate(out.reshape(parts, each * width)):
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([0]), pa.array([some], pa.list_(pa.float64()))], schema=blocks.SCHEMA)

    got = blocks.summed(rows.mapInArrow(run, blocks.DDL), each * width).toArrow()  # models x width numbers
    out = np.zeros((parts, each * width))
    for batch in got.to_batches():
        for at, x in zip(batch["bi"].to_pylist(), blocks.arrays(batch["x"], each * width), strict=True):
            out[at] = x
    return out.reshape(parts * each, width)[:models]


def _chances(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _ridge(d: int, c: float) -> np.ndarray:
    """The penalty of each weight; the intercept is free but for what keeps it finite."""
    return np.r_[np.full(d, 1 / c), 1e-6]


def _moments(rows: DataFrame, d: int, names: np.ndarray, split: np.ndarray, label: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each model (a split and a label): loss, gradient and second derivatives of the logistic loss at its weights, by one pass over all rows."""

    def add(out: np.ndarray, x: np.ndarray, y: np.ndarray, flags: np.ndarray) -> None:
        z, mine, t = x @ weights.T, y[:, label], flags[:, split].astype(float)
        p = _chances(z)
        out[:, 0] += (t * (np.logaddexp(0, z) - mine * z)).sum(0)
        out[:, 1 : d + 2] += (t * (p - mine)).T @ x
        v = t * p * (1 - p)
        for m in range(len(split)):
            out[m, d + 2 :] += (x.T @ (v[:, m, None] * x)).ravel()

    return _summed(rows, d, names, len(split), 1 + (d + 1) + (d + 1) ** 2, add)


def fit_logistic(rows: DataFrame, d: int, names: np.ndarray, splits: int, *, c: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights (splits, labels, d + 1) of binary logistic regressions with an L2 penalty of 1 / (2 c), one for each split and label.

    rows: node, vec, labels, flags (which splits learn from the row). All models
    take Newton's steps at once, as many of them as PASS_NUMBERS allows; a step
    that doesn't lower a model's loss is halved.
    """
    ridge = _ridge(d, c)
    split, label = (x.ravel() for x in np.meshgrid(np.arange(splits), np.arange(len(names)), indexing="ij"))
    out, at_once = np.zeros((len(split), d + 1)), max(1, PASS_NUMBERS // (1 + (d + 1) * (d + 2)))
    for first in range(0, len(split), at_once):
        mine = slice(first, first + at_once)
        best = out[mine]
        step, least = np.zeros_like(best), np.full(len(best), np.inf)
        for _ in range(rounds):
            tried = best + step
            found = _moments(rows, d, names, split[mine], label[mine], tried)
            loss = found[:, 0] + 0.5 * (tried**2 * ridge).sum(1)
            better = loss <= least + 1e-9 * (1 + np.abs(loss))
            for m in np.flatnonzero(better):
                best[m], least[m] = tried[m], loss[m]
                slope = found[m, 1 : d + 2] + ridge * tried[m]
                step[m] = -np.linalg.solve(found[m, d + 2 :].reshape(d + 1, d + 1) + np.diag(ridge), slope)
            step[~better] /= 2
            if np.abs(step).max(initial=0) < 1e-7 * (1 + np.abs(best).max(initial=0)):
                break
        out[mine] = best
    return out.reshape(splits, len(names), d + 1)


def spectrum(rows: DataFrame, d: int, c: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of the second moments of the vectors that the first split learns from, in units of the penalty."""

    def add(out: np.ndarray, x: np.ndarray, y: np.ndarray, flags: np.ndarray) -> None:
        out[0] += (x.T @ (flags[:, :1] * x)).ravel()

    unit = np.sqrt(_ridge(d, c))
    return np.linalg.eigh(_summed(rows, d, np.array([], np.int64), 1, (d + 1) ** 2, add).reshape(d + 1, d + 1) / np.outer(unit, unit))


def _slopes(rows: DataFrame, d: int, names: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each label of names, on the first split: loss, sum of p (1 - p), gradient."""

    def add(out: np.ndarray, x: np.ndarray, y: np.ndarray, flags: np.ndarray) -> None:
        t = flags[:, :1].astype(float)
        z = x @ weights.T
        p = _chances(z)
        out[:, 0] += (t * (np.logaddexp(0, z) - y * z)).sum(0)
        out[:, 1] += (t * p * (1 - p)).sum(0)
        out[:, 2:] += (t * (p - y)).T @ x

    return _summed(rows, d, names, len(names), d + 3, add)


def _curved(rows: DataFrame, d: int, names: np.ndarray, weights: np.ndarray, along: np.ndarray) -> np.ndarray:
    """For each label of names, on the first split: the second derivatives at its weights times its direction."""

    def add(out: np.ndarray, x: np.ndarray, y: np.ndarray, flags: np.ndarray) -> None:
        p = _chances(x @ weights.T)
        out += (flags[:, :1] * p * (1 - p) * (x @ along.T)).T @ x

    return _summed(rows, d, names, len(names), d + 1, add)


def fit_truncated(rows: DataFrame, d: int, names: np.ndarray, basis: tuple[np.ndarray, np.ndarray], *, c: float = 1.0, rounds: int = 60, inner: int = 60) -> np.ndarray:
    """Weights (labels, d + 1) of the models of fit_logistic for the first split, by truncated Newton's steps.

    A step solves for its direction by conjugate gradients; each of their
    rounds is a pass that adds up d + 1 numbers a model (second derivatives
    times a direction), where fit_logistic adds up (d + 1)^2. All labels go in
    step, and those that are done leave the passes. Directions are scaled by
    the second moments of all vectors (basis, from `spectrum`), times the
    label's mean p (1 - p), so few rounds are needed. A label that all or no
    rows have starts where its intercept ends.
    """
    values, vectors = basis
    ridge = _ridge(d, c)
    unit = np.sqrt(ridge)

    def scaled(mean: np.ndarray, r: np.ndarray) -> np.ndarray:
        return (r / unit @ vectors / (1 + mean[:, None] * np.maximum(values, 0))) @ vectors.T / unit

    def direction(who: np.ndarray, slope: np.ndarray, mean: np.ndarray, loss: np.ndarray) -> np.ndarray:
        s, r = np.zeros_like(slope), -slope
        p = scaled(mean, r)
        rz = (r * p).sum(1)
        goal = rz * np.minimum(1e-2, rz / (1 + np.abs(loss)))
        going = np.flatnonzero(rz > 0)
        for _ in range(inner):
            if not len(going):
                break
            h = _curved(rows, d, names[who[going]], best[who[going]], p[going]) + ridge * p[going]
            far = (rz[going] / (p[going] * h).sum(1))[:, None]
            s[going] += far * p[going]
            r[going] -= far * h
            z = scaled(mean[going], r[going])
            new = (r[going] * z).sum(1)
            p[going] = z + (new / rz[going])[:, None] * p[going]
            rz[going] = new
            going = going[new > goal[going]]
        return s

    best, step, least = np.zeros((len(names), d + 1)), np.zeros((len(names), d + 1)), np.full(len(names), np.inf)
    found = _slopes(rows, d, names, best)
    n = 4 * found[:, 1]  # p is a half everywhere
    best[:, d] = _first_intercepts(n, np.clip(np.rint(n / 2 - found[:, -1]), 0, n), ridge[d])
    going = np.flatnonzero(n > 0)
    for _ in range(rounds):
        if not len(going):
            break
        tried = best[going] + step[going]
        found = _slopes(rows, d, names[going], tried)
        loss = found[:, 0] + 0.5 * (tried**2 * ridge).sum(1)
        better = loss <= least[going] + 1e-9 * (1 + np.abs(loss))
        step[going[~better]] /= 2
        who = going[better]
        best[who], least[who] = tried[better], loss[better]
        slope = found[better, 2:] + ridge * best[who]
        step[who] = direction(who, slope, found[better, 1] / n[who], loss[better])
        done = who[-(slope * step[who]).sum(1) <= 1e-12 * (1 + np.abs(loss[better]))]
        best[done] += step[done]  # what is left to gain can't be told from rounding, so nothing is tried
        still = np.abs(step[going]).max(1) >= 1e-7 * (1 + np.abs(best[going]).max(1))
        going = np.setdiff1d(going[still], done)
    return best


def _first_intercepts(n: np.ndarray, positive: np.ndarray, penalty: float) -> np.ndarray:
    """The log odds of a label; if all or no rows have it, the intercept at which its penalty is as steep as the loss."""
    out = np.log((positive + 0.5) / (n - positive + 0.5))
    flat = (positive == 0) | (positive == n)
    size = np.full(n.shape, 10.0)
    for _ in range(30):
        size = np.maximum(1.0, np.log(np.maximum(n, 1) / (penalty * size)))
    return np.where(flat, np.sign(out) * size, out)


def one_vs_rest(train: DataFrame, test: DataFrame, labels: list[int], *, c: float = 1.0) -> DataFrame:
    """node, label, p: one binary logistic regression with an L2 penalty for each label, all fitted together. train, test: node, vec; train also labels (an array)."""
    names = np.array(sorted(labels), np.int64)
    known = cut(train.select("node", "vec", F.col("labels").cast("array<long>").alias("labels"), F.array(F.lit(True)).alias("flags")))
    d = known.agg(F.max(F.size("vec"))).first()[0] or 0
    weights = fit_logistic(known, d, names, 1, c=c)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, x, _, _, _ in _slices(batches, d, names, len(names)):
            p = _chances(x @ weights.T)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes, len(names)), pa.int64()), pa.array(np.tile(names, len(nodes)), pa.int64()), pa.array(p.ravel())], ["node", "label", "p"])

    asked = test.select("node", "vec", F.array().cast("array<long>").alias("labels"), F.array(F.lit(False)).alias("flags"))
    return asked.mapInArrow(run, "node long, label long, p double")


def _tested(rows: DataFrame, d: int, names: np.ndarray, weights: np.ndarray) -> DataFrame:
    """split, label, tp, fp, fn of the rows that a split doesn't learn from, each predicted as many labels as it has, counted inside the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(weights), 3, len(names)), np.int64)
        for _, x, y, flags, _ in _slices(batches, d, names, len(names)):
            rank_of = np.arange(len(names))
            for s, w in enumerate(weights):
                mine = ~flags[:, s].astype(bool)
                truth = y[mine]
                order = np.argsort(-(x[mine] @ w.T), axis=1, kind="stable")  # ties go to the smaller label
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.broadcast_to(rank_of, order.shape), 1)
                got = place < truth.sum(1)[:, None]
                out[s] += np.stack([(got & truth).sum(0), (got & ~truth).sum(0), (~got & truth).sum(0)])
        s, k = np.nonzero(out.sum(1))
        columns = [pa.array(s), pa.array(names[k]), *(pa.array(out[s, i, k]) for i in range(3))]
        yield pa.RecordBatch.from_arrays(columns, ["split", "label", "tp", "fp", "fn"])

    counts = rows.mapInArrow(run, "split long, label long, tp long, fp long, fn long")
    return counts.groupBy("split", "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def _ranks(nodes: DataFrame, fractions: list[float], repeats: int, seed: int) -> DataFrame:
    """node, learns: for each repeat and fraction, whether the node is among the first ones in the repeat's order.

    All repeats are ranked at once: their orders follow each other in one range-partitioned order, and each has all nodes.
    """
    keyed = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    keyed = keyed.withColumn("key", mix_key(F.col("node"), F.col("repeat").cast("long") + seed))
    ranked = global_rank(keyed, ["repeat", "key", "node"]).withColumn("n", (F.col("n") / repeats).cast("long"))
    learns = F.array(*[F.col("rank") - F.col("repeat") * F.col("n") <= F.floor(F.lit(f) * F.col("n")) for f in fractions])
    of_node = ranked.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("repeat", learns.alias("learns")))).alias("all"))  # one for each repeat
    return of_node.select("node", F.transform("all", lambda x: x["learns"]).alias("learns"))


def _best(rows: DataFrame, d: int, names: np.ndarray, weights: np.ndarray) -> DataFrame:
    """node, k, best: of each row that the first split doesn't learn from, the k best of names by (minus score, label), k being its number of labels among all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, x, _, flags, k in _slices(batches, d, names, len(names)):
            asked = np.flatnonzero(~flags[:, 0].astype(bool) & (k > 0))
            z, of, score, label = -(x[asked] @ weights.T), [], [], []
            for r, most in enumerate(k[asked]):
                least = np.partition(z[r], most - 1)[most - 1] if most < len(names) else np.inf
                first = np.flatnonzero(z[r] <= least)
                first = first[np.argsort(z[r, first], kind="stable")][:most]  # ties go to the smaller label
                of.append(len(first))
                score.append(z[r, first])
                label.append(names[first])
            if len(asked):
                items = pa.StructArray.from_arrays([pa.array(np.concatenate(score)), pa.array(np.concatenate(label))], ["s", "label"])
                best = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(of)], pa.int32()), items)
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in asked], pa.int64()), pa.array(k[asked], pa.int64()), best], ["node", "k", "best"])

    return rows.mapInArrow(run, "node long, k long, best array<struct<s: double, label: long>>")


def _banded(rows: DataFrame, d: int, labels: int, numbers: int, c: float) -> DataFrame:
    """label, tp, fp, fn of one split, its labels fitted in bands of bounded size; a row's best labels of each band are merged. rows: node, vec, labels, flags.

    Rows of equal vectors, labels and flags are one row with their number, so the
    passes cost what different rows there are.
    """
    kinds = rows.groupBy("vec", F.array_sort("labels").alias("labels"), "flags").agg(F.count(F.lit(1)).alias("rows"))
    rows = cut(kinds.withColumn("node", F.monotonically_increasing_id()))  # a node may have several rows
    learning = rows.select("node", "vec", "labels", F.transform("flags", lambda f: F.when(f, F.col("rows")).otherwise(F.lit(0)).cast("double")).alias("flags"))
    basis, wide, found = spectrum(learning, d, c), max(1, numbers // (d + 3)), None
    for lo in range(0, labels, wide):
        names = np.arange(lo, min(labels, lo + wide))
        band = cut(_best(rows.select("node", "vec", "labels", "flags"), d, names, fit_truncated(learning, d, names, basis, c=c)))  # the band's weights go with it
        found = band if found is None else found.unionByName(band)
    merged = found.groupBy("node").agg(F.array_sort(F.flatten(F.collect_list("best"))).alias("best"), F.max("k").cast("int").alias("k"))  # k of each band at most
    predicted = merged.select("node", F.explode(F.slice("best", F.lit(1), F.col("k"))).alias("b")).select("node", F.col("b.label").alias("label"))
    truth = rows.filter(~F.get("flags", F.lit(0))).select("node", F.explode("labels").alias("label"))
    return confusion(predicted, truth, rows.select("node", "rows"))


def classify(vectors: DataFrame, truth: DataFrame, fractions: list[float], *, repeats: int = 1, seed: int = 0, c: float = 1.0, numbers: int | None = None) -> DataFrame:
    """fraction, micro_f1, macro_f1, means over repeats of: split, train, take the k best labels, score.

    vectors: node, vec (of one length); truth: node, label (null labels are
    passed over). Labels are numbered by a join, so no list of them is ever held
    in one place. If the second derivatives of a split's models fit `numbers`
    numbers (PASS_NUMBERS), the models of as many fractions, repeats and labels
    as that allows are fitted in common passes by Newton's steps. Else each
    split's labels are fitted band by band by truncated ones, d + 3 numbers a
    label and pass, and a row's best labels of all bands are merged; the weights
    of one band pass through the driver. Both find the same models.
    """
    spark: SparkSession = vectors.sparkSession
    numbers = numbers or PASS_NUMBERS
    truth = truth.select("node", F.col("label").cast("long").alias("label")).filter("label IS NOT NULL").distinct()
    places = cut(global_rank(truth.select("label").distinct(), ["label"]))
    labels = places.count()
    sets = truth.join(places, "label").groupBy("node").agg(F.collect_list(F.col("rank") - 1).alias("labels"))
    rows = cut(vectors.join(sets, "node").select("node", "vec", "labels"))
    d = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    rows = cut(rows.join(_ranks(rows.select("node").distinct(), fractions, repeats, seed), "node"))
    splits = [(f, r) for r in range(repeats) for f in range(len(fractions))]
    narrow = labels * (1 + (d + 1) * (d + 2)) <= numbers
    at_once, found = max(1, numbers // max(1, labels * (d + 1))) if narrow else 1, []
    for first in range(0, len(splits), at_once):
        mine = splits[first : first + at_once]
        flagged = rows.select("node", "vec", "labels", F.array(*[F.get(F.get("learns", F.lit(r)), F.lit(f)) for f, r in mine]).alias("flags"))
        if narrow:
            flagged, names = cut(flagged), np.arange(labels)
            counts = cut(_tested(flagged, d, names, fit_logistic(flagged, d, names, len(mine), c=c)))
        else:
            counts = cut(_banded(flagged, d, labels, numbers, c).withColumn("split", F.lit(0)))
        micro = counts.groupBy("split").agg((F.sum(F.col("tp") * 2) / F.sum(F.col("tp") * 2 + F.col("fp") + F.col("fn"))).alias("micro_f1"), F.avg(F.col("tp") * 2 / (F.col("tp") * 2 + F.col("fp") + F.col("fn"))).alias("macro_f1"))
        got = {r["split"]: (r["micro_f1"], r["macro_f1"]) for r in micro.collect()}
        found += [(fractions[f], *got.get(k, (0.0, 0.0))) for k, (f, _) in enumerate(mine)]
    scores = spark.createDataFrame(found, "fraction double, micro_f1 double, macro_f1 double")
    return scores.groupBy("fraction").agg(F.avg("micro_f1").alias("micro_f1"), F.avg("macro_f1").alias("macro_f1"))


def report(scores: DataFrame, *, model: str, task: str, seconds: float, parties: int, communication: int) -> DataFrame:
    """The record of a run, one row for each fraction: model, task, fraction, seconds, micro_f1, macro_f1, parties, communication (bytes of all parties)."""
    given = [F.lit(model).alias("model"), F.lit(task).alias("task"), "fraction", F.lit(float(seconds)).alias("seconds"), "micro_f1", "macro_f1"]
    return scores.select(*given, F.lit(parties).alias("parties"), F.lit(communication).cast("long").alias("communication"))


def mean_absolute_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """mae over the cells that both tables (i, j, v) have."""
    pairs = a.select("i", "j", F.col("v").alias("x")).join(b.select("i", "j", F.col("v").alias("y")), ["i", "j"])
    return pairs.agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("mae"))


def mean_percentage_error(a: DataFrame, b: DataFrame, *, absolute: bool = True) -> DataFrame:
    """mape of b against a in percent, without cells where a is 0; absolute compares magnitudes, so signs of vectors don't count."""
    size = F.abs if absolute else (lambda x: x)
    pairs = a.select("i", "j", size(F.col("v")).alias("x")).join(b.select("i", "j", size(F.col("v")).alias("y")), ["i", "j"])
    return pairs.agg((F.avg(F.abs((F.col("y") - F.col("x")) / F.nullif(F.col("x"), F.lit(0.0)))) * 100).alias("mape"))


def panel_cells(panel: DataFrame) -> DataFrame:
    """A panel (i, y) as cells (i, j, v)."""
    return panel.select("i", F.posexplode("y").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), "v")
