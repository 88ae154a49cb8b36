from pathlib import Path

import numpy as np
import psutil
import pytest
from pyspark.sql import functions as F

from meshvec.functions.lineage import cut
from meshvec.operators import blocks, evaluate, factor, masks, matrix, proximity, stats, walks
from meshvec.operators import edges as E
from meshvec.plans import embeddings
from meshvec.sources import graphs


def coordinates(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "i long, j long, v double")


@pytest.fixture(scope="module")
def ab(spark):
    rng = np.random.default_rng(1)
    a, b = (rng.normal(size=(12, 12)) * (rng.random((12, 12)) < 0.4) for _ in range(2))
    return a, b, coordinates(spark, a), coordinates(spark, b)


def test_algebra(ab):
    a, b, A, B = ab
    assert np.allclose(matrix.to_dense(matrix.dot(A, B), 12), a @ b)
    assert np.allclose(matrix.to_dense(matrix.add((1, A), (-2, B)), 12), a - 2 * b)
    assert np.allclose(matrix.to_dense(matrix.transpose(A), 12), a.T)
    d = np.array([0.0, *range(1, 12)])
    D = matrix.diagonal(A.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(d)], "node long, deg double"))
    inv = np.divide(1, d, out=np.zeros(12), where=d != 0)
    assert np.allclose(matrix.to_dense(matrix.diag_left(D, A, inverse=True), 12), inv[:, None] * a)
    assert np.allclose(matrix.to_dense(matrix.diag_right(A, D), 12), a * d)
    blocks = matrix.block_counts(A, 5).collect()
    assert sum(r["nnz"] for r in blocks) == np.count_nonzero(a) and max(r["bi"] for r in blocks) == 2


def test_slices_and_sizes(ab):
    a, _, A, _ = ab
    kept = matrix.slices(A, 12, 5)
    assert kept.count() == np.count_nonzero(a)
    assert matrix.slices(A, 12, 5, keep_rest=False).count() == np.count_nonzero(a[:, :10])
    assert matrix.block_size(10312) == 1289 and matrix.block_size(50) is None
    with pytest.raises(ValueError):
        matrix.to_dense(A, 3000)


@pytest.mark.parametrize("size", [5, 12, 40])
def test_block_algebra(spark, ab, size):
    a, b, A, B = ab
    ba, bb = blocks.to_blocks(A, size), blocks.to_blocks(B, size)
    dense = lambda m: matrix.to_dense(blocks.from_blocks(m, size), 12)
    assert np.allclose(dense(ba), a)
    assert np.allclose(dense(blocks.dot(ba, bb, size)), a @ b)
    assert np.allclose(dense(blocks.add(size, (1, ba), (-2, bb), (1, ba))), 2 * a - 2 * b)
    assert np.allclose(dense(blocks.transpose(ba, size)), a.T)
    empty = blocks.to_blocks(A.limit(0), size)
    assert blocks.dot(empty, bb, size).count() == 0 and blocks.from_blocks(empty, size).count() == 0


def test_few_blocks_are_held(spark, monkeypatch):
    monkeypatch.setattr(blocks, "KEPT", 2)
    a = np.random.default_rng(8).normal(size=(20, 20))
    A = blocks.to_blocks(coordinates(spark, a), 3)
    assert np.allclose(matrix.to_dense(blocks.from_blocks(blocks.dot(A, A, 3), 3), 20), a @ a)
    parts = list(blocks._added(iter([(i % 5, 0, np.ones(4)) for i in range(20)])))
    assert all(p.num_rows == 1 for p in parts) and sum(p.column(2)[0][0].as_py() for p in parts) == 20


def test_masks(spark):
    q = masks.orthogonal_blocks(spark, 23, 10, 4)
    dense = matrix.to_dense(blocks.from_blocks(q, 10), 23)
    assert np.allclose(dense @ dense.T, np.eye(23)) and not dense[:10, 10:].any()
    a = np.random.default_rng(2).random((23, 23))
    A, P = blocks.to_blocks(coordinates(spark, a), 10), masks.orthogonal_blocks(spark, 23, 10, 5)
    back = lambda m: matrix.to_dense(blocks.from_blocks(m, 10), 23)
    assert np.allclose(back(masks.demask(P, masks.mask(P, A, q, 10), q, 10)), a)
    assert np.allclose(back(masks.demask(P, masks.masked_square(P, A, q, 10), q, 10)), a @ a)
    m = matrix.to_dense(masks.random_matrix(spark, 23, 1, 10), 23)
    assert m.max() < 10 and np.count_nonzero(m) == 10 * 10 * 2 + 9


def test_secure_sum_hides_and_cancels(spark, ab):
    a, b, A, B = ab
    held = A.withColumn("party", F.lit(1)).unionByName(B.withColumn("party", F.lit(2)))
    assert np.allclose(matrix.to_dense(masks.secure_sum(held, 2, 9), 12), a + b)


@pytest.mark.parametrize("size", [5, 12])
def test_protocol_square(spark, ab, size):
    a, b, A, B = ab
    square = masks.protocol_square(spark, blocks.to_blocks(A, size), blocks.to_blocks(B, size), 12, size=size)
    assert np.allclose(matrix.to_dense(blocks.from_blocks(square, size), 12), (a + b) @ (a + b))


def test_party_squares(ab):
    a, b, A, B = ab
    x = A.withColumn("party", F.lit(1)).unionByName(B.withColumn("party", F.lit(2))).unionByName(A.withColumn("party", F.lit(3)))
    assert np.allclose(matrix.to_dense(proximity.party_squares(x, 3), 12), (2 * a + b) @ (2 * a + b))


def test_window_formula(spark):
    edges, _ = graphs.planted_partition(spark, 30, 3, 0.6, 0.1, 4)
    a = np.zeros((30, 30))
    for r in edges.collect():
        a[r["src"], r["dst"]] = 1
    d = a.sum(0)
    x = a / np.where(d > 0, d, 1)[:, None]
    from meshvec.operators import stats

    for window in (1, 2, 3):
        want = a.sum() / (window * 2) * sum(np.linalg.matrix_power(x, r) for r in range(1, window + 1)) / np.where(d > 0, d, 1)
        m = proximity.proximity(matrix.from_edges(edges), stats.in_degree(edges), stats.volume(edges, "sum_weights"), window=window, negative=2.0)
        assert np.allclose(matrix.to_dense(m, 30), want)
        assert np.allclose(matrix.to_dense(proximity.truncated_log(m), 30), np.log(np.maximum(want, 1)))


def test_sampling_tends_to_its_expectation(spark):
    edges, _ = graphs.planted_partition(spark, 12, 2, 0.8, 0.3, 2)
    held = edges.select("src", "dst", F.lit(1).alias("party"), F.lit(1.0).alias("w"))
    got = matrix.to_dense(walks.path_samples(held, window=3, per_edge=2000, workers=1, parties=1), 12)
    want = matrix.to_dense(walks.expected_sparsifier(matrix.from_edges(held), window=3, parties=1), 12)
    assert np.abs(got - want).sum() / want.sum() < 0.06
    assert abs(got.sum() / want.sum() - 1) < 1e-6
    undirected = held.filter("src < dst")
    flipped = matrix.to_dense(walks.path_samples(undirected, window=3, per_edge=2000, workers=1, parties=1, directed=False), 12)
    assert abs(flipped.sum() / want.sum() - 0.5) < 1e-6


def test_parties_walk_on_their_own_edges(spark):
    rng = np.random.default_rng(3)
    own = {p: {(i, (i + p) % 10) for i in range(10)} | {(int(i), int(j)) for i, j in rng.integers(0, 10, (12, 2)) if i != j} | {(0, 5)} for p in (1, 2)}
    held = spark.createDataFrame([(i, j, p, 1.0) for p in own for i, j in sorted(own[p])], "src long, dst long, party int, w double")
    got = walks.path_samples(held, window=3, per_edge=4000, workers=1, parties=2)
    for p in own:
        mine = matrix.to_dense(got.filter(F.col("party") == p).select("i", "j", "v"), 10)
        want = matrix.to_dense(walks.expected_sparsifier(matrix.from_edges(held.filter(F.col("party") == p)), window=3, parties=2), 10)
        assert np.abs(mine - want).sum() / want.sum() < 0.06
        assert not mine[want == 0].any()


def test_dead_ends_stay(spark):
    held = spark.createDataFrame([(0, 1, 1, 1.0)], "src long, dst long, party int, w double")
    rows = walks.path_samples(held, window=2, per_edge=64, workers=1, parties=1).collect()
    assert {(r["i"], r["j"]) for r in rows} <= {(0, 1), (1, 1)}


def test_stretches_of_a_hub_touch(spark):
    """One node with most edges, over several ranges, and weights from 1e-6 to 1e6."""
    rng = np.random.default_rng(8)
    weights = {(0, j): float(10 ** rng.uniform(-6, 6)) for j in range(1, 900)} | {(i, 0): 1.0 for i in range(1, 40)} | {(3, 7): 0.0}
    edges = spark.createDataFrame([(1, i, j, w) for (i, j), w in weights.items()], "party int, src long, dst long, w double").repartition(7)
    rows = sorted((r["src"], r["dst"], r["low"], r["high"], r["total"], r["deg"]) for r in walks.cumulative_weights(edges).collect())
    assert len(rows) == len(weights) - 1  # no stretch without weight
    hub = [r for r in rows if r[0] == 0]
    assert hub[0][2] == 0.0 and hub[-1][3] == hub[-1][4] and all(a[3] == b[2] for a, b in zip(hub, hub[1:]))
    assert {r[5] for r in hub} == {899} and np.isclose(hub[-1][4], sum(w for (i, _), w in weights.items() if i == 0))
    guide, _ = walks.walk_index(edges)
    assert guide.count() <= 2 * len(weights)
    walkers = spark.range(0, 40_000, 1, 4).select(F.lit(1).alias("party"), F.col("id").alias("draw"), F.lit(0).cast("long").alias("at"), F.lit(899).cast("long").alias("deg"), F.lit(0).alias("hits"))
    ends = {r["at"]: r["count"] for r in walks.step(walkers, guide, "at", "deg", 5).groupBy("at").count().collect()}
    total = sum(w for (i, _), w in weights.items() if i == 0)
    assert sum(ends.values()) == 40_000 and 0 not in ends
    for (i, j), w in weights.items():
        if i == 0:
            p = w / total
            assert abs(ends.get(j, 0) / 40_000 - p) <= 6 * (p * (1 - p) / 40_000) ** 0.5 + 1 / 40_000


def test_weighted_samples_tend_to_their_expectation(spark):
    rng = np.random.default_rng(12)
    own = {(i, int(j)): float(rng.integers(1, 20)) for i in range(9) for j in rng.integers(0, 9, 4) if i != j}
    held = spark.createDataFrame([(i, j, 1, w) for (i, j), w in own.items()], "src long, dst long, party int, w double")
    got = matrix.to_dense(walks.path_samples(held, window=3, per_edge=3000, workers=1, parties=1, weighted=True), 9)
    a = held.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("v"))
    want = matrix.to_dense(walks.expected_sparsifier(a, window=3, parties=1, start=a.withColumn("v", F.lit(1.0))), 9)
    assert np.abs(got - want).sum() / want.sum() < 0.06
    plain = matrix.to_dense(walks.expected_sparsifier(a.withColumn("v", F.lit(1.0)), window=3, parties=1), 9)
    assert np.abs(got - plain).sum() / want.sum() > 0.1


def test_walkers_at_dead_ends_spread(spark):
    """No key of a step's exchange is null or shared by all that stay."""
    held = spark.createDataFrame([(i, 1000, 1, 1.0) for i in range(5)], "src long, dst long, party int, w double")
    guide, _ = walks.walk_index(held)
    rows = spark.range(0, 4000, 1, 2).select(F.lit(1).alias("party"), F.col("id").alias("draw"), F.lit(1000).cast("long").alias("at"), F.expr("if(id < 0, id, null)").alias("deg"), F.lit(0).alias("hits"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        met = walks.step(rows, guide, "at", "deg", 3)
        sizes = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 1.3 * min(sizes)
        assert met.filter("at = 1000 and hits = 0").count() == 4000
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_alias_tables_of_a_hub(spark):
    """A node of 50,000 neighbours is no row of more than a chunk, and is drawn from by its weights."""
    edges = spark.range(0, 50_000, 1, 4).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), (1 + F.col("id") % 7).cast("double").alias("w"))
    edges = edges.unionByName(spark.createDataFrame([(1, 2, 3.0), (1, 5, 1.0)], "src long, dst long, w double"))
    low, top = stats.hub_alias_tables(edges)
    assert low.agg(F.max(F.size("neighbours"))).first()[0] <= stats.CHUNK and low.filter("node = 0").count() == 13
    p = stats.hub_alias_probabilities(low, top).join(edges, (F.col("node") == F.col("src")) & (F.col("neighbour") == F.col("dst")))
    total = sum(1 + i % 7 for i in range(50_000))
    off = p.select(F.abs(F.col("p") - F.col("w") / F.when(F.col("node") == 0, float(total)).otherwise(4.0)).alias("off")).agg(F.max("off"), F.count("off")).first()
    assert off[0] < 1e-12 and off[1] == 50_002
    draws = spark.range(0, 30_000, 1, 4).select(F.lit(0).cast("long").alias("node"), F.col("id").alias("draw")).unionByName(spark.createDataFrame([(9, 1)], "node long, draw long"))
    drawn = stats.hub_alias_draw(draws, low, top, 3)
    shares = {r["k"]: r["n"] / 30_000 for r in drawn.filter("drawn is not null").groupBy((F.col("drawn") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(abs(shares[k] - (1 + k) / 28) < 0.015 for k in range(7))
    assert drawn.filter("node = 9 and drawn is null").count() == 1


def test_products_of_a_hub_are_spread(spark):
    """A star of 1,500 leaves both ways beside a sparse rest: no task has much more of its products than others, and the cells are those of the plain product."""
    star = spark.range(1, 1501).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("j"), (F.col("id") % 5 + 1.0).alias("v"))
    star = star.unionByName(star.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    rest = spark.range(0, 3000).select((F.col("id") % 1500 + 2000).alias("i"), (F.col("id") * 7 % 1500 + 2000).alias("j"), F.lit(1.0).alias("v"))
    a = cut(star.unionByName(rest))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        assert {r["k"] for r in matrix.hot_inner(a, a).collect()} == {0}
        sizes = sorted(r["count"] for r in matrix.meetings(a, a).groupBy(F.spark_partition_id()).count().collect())
        assert len(sizes) == 16 and sizes[-1] <= 3 * sizes[8]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        for k in list(settings)[:2]:
            spark.conf.unset(k)
    off = matrix.add((1, matrix.dot_spread(a, a)), (-1, matrix.dot(a, a)))
    assert off.agg(F.max(F.abs("v")), F.count("v")).first() == (0.0, matrix.dot(a, a).count())


def test_spread_product_of_small_and_empty(ab, spark):
    a, b, A, B = ab
    assert np.allclose(matrix.to_dense(matrix.dot_spread(A, B), 12), a @ b)
    none = spark.createDataFrame([], "i long, j long, v double")
    assert matrix.dot_spread(none, B).count() == 0


def test_laplacian(ab):
    a, _, A, _ = ab
    assert np.allclose(matrix.to_dense(walks.laplacian(A), 12), np.diag(a.sum(0)) - a)


def test_qr_and_svd(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(40, 6)) @ rng.normal(size=(6, 40))
    A = coordinates(spark, a)
    u, s = factor.randomized_svd(A, 6, rounds=2)
    dense = np.zeros((40, len(s)))
    for r in u.collect():
        dense[r["i"]] = r["y"]
    assert np.allclose(dense.T @ dense, np.eye(len(s)), atol=1e-6)
    assert np.allclose(s, np.linalg.svd(a)[1][: len(s)])
    assert np.allclose(dense @ dense.T @ a, a, atol=1e-6)
    y = spark.createDataFrame([(i, [1.0, 2.0, float(i)]) for i in range(9)], "i long, y array<double>")
    q, width = factor.orthonormal(y, 3)  # the second column is twice the first
    assert width == 2 and np.allclose(factor.gram(q, 2), np.eye(2), atol=1e-8)


@pytest.mark.parametrize("condition", [1e3, 1e12])
def test_qr_of_an_ill_conditioned_panel(spark, condition):
    rng = np.random.default_rng(6)
    u, v = np.linalg.qr(rng.normal(size=(500, 12)))[0], np.linalg.qr(rng.normal(size=(12, 12)))[0]
    a = u * np.geomspace(1, 1 / condition, 12) @ v.T
    y = spark.createDataFrame([(i, [float(x) for x in a[i]]) for i in range(500)], "i long, y array<double>").repartition(9)
    q, width = factor.orthonormal(y, 12)
    dense = np.zeros((500, width))
    for r in q.collect():
        dense[r["i"]] = r["y"]
    assert width == np.linalg.qr(a)[0].shape[1] == 12
    assert np.abs(dense.T @ dense - np.eye(12)).max() < 1e-10
    assert np.abs(a - dense @ (dense.T @ a)).max() < 1e-14
    r = factor.triangle(y, 12)
    assert np.allclose(np.linalg.svd(r)[1] * np.geomspace(1, condition, 12), 1, rtol=1e-3)


def test_tree_of_qrs_with_few_rows_a_task(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(40, 5))
    y = spark.createDataFrame([(i, [float(x) for x in a[i]]) for i in range(40)], "i long, y array<double>").repartition(33)
    r = factor.triangle(y, 5)
    assert np.allclose(r.T @ r, a.T @ a)
    assert factor.triangle(y.filter("i < 0"), 5).shape == (0, 5)


def test_svd_to_a_tolerance(spark):
    """A spectrum that decays slowly, which a fixed number of rounds misses."""
    rng = np.random.default_rng(9)
    u, v = np.linalg.qr(rng.normal(size=(90, 60)))[0], np.linalg.qr(rng.normal(size=(70, 60)))[0]
    s = 1 / np.sqrt(1 + np.arange(60) / 20)
    A = coordinates(spark, u * s @ v.T)
    got, values, bounds = factor.svd_to_tolerance(A, 5, tolerance=1e-7, oversample=3)
    assert np.abs(values - s[:5]).max() < 1e-6 and bounds.max() <= 1e-7 and (np.abs(values - s[:5]) <= bounds + 1e-12).all()
    dense = np.zeros((90, 5))
    for r in got.collect():
        dense[r["i"]] = r["y"]
    assert np.allclose(np.abs(np.sum(dense * u[:, :5], axis=0)), 1, atol=1e-5)
    _, _, early = factor.svd_to_tolerance(A, 5, tolerance=1e-7, oversample=0, expansions=1, cycles=1)
    assert early.max() > 1e-7  # what isn't reached is told


def test_empty_matrix_embeds_to_zeros(spark):
    empty = spark.createDataFrame([], "i long, j long, v double")
    emb = factor.embedding(empty, spark.range(2).withColumnRenamed("id", "node"), 3)
    assert sorted((r["node"], r["vec"]) for r in emb.collect()) == [(0, [0.0] * 3), (1, [0.0] * 3)]


def test_normalize_and_dictionary(spark):
    p = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0])], "i long, y array<double>")
    assert sorted((r["i"], r["y"]) for r in factor.l2_normalize(p).collect()) == [(0, [0.6, 0.8]), (1, [0.0, 0.0])]


def test_embedding_finds_communities(spark):
    edges, labels = graphs.planted_partition(spark, 60, 2, 0.5, 0.05, 7)
    emb = embeddings.exact_embedding(edges.withColumn("w", F.lit(1.0)), 4, rounds=3)
    scores = evaluate.classify(emb, labels, [0.5]).first()
    assert scores["micro_f1"] > 0.9
    split = E.split_parties(edges, 2)
    sampled = embeddings.sampled_embedding(split, 4, parties=2, window=2, per_edge=20, workers=1, rounds=3)
    assert sampled.count() == emb.count()
    assert all(abs(np.linalg.norm(r["vec"]) - 1) < 1e-6 or not any(r["vec"]) for r in sampled.collect())


def test_metrics(spark):
    truth = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 2)], "node long, label int")
    scores = spark.createDataFrame([(n, c, p) for n, row in {1: (0.9, 0.2, 0.5), 2: (0.1, 0.1, 0.0), 3: (0.2, 0.3, 0.9)}.items() for c, p in enumerate(row)], "node long, label int, p double")
    top = evaluate.topk(scores, truth)
    assert sorted(tuple(r) for r in top.collect()) == [(1, 0), (1, 2), (2, 0), (3, 2)]
    counts = evaluate.confusion(top, truth)
    assert {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in counts.collect()} == {0: (1, 1, 0), 1: (0, 0, 2), 2: (1, 1, 0)}
    assert evaluate.micro_f1(counts).first()[0] == pytest.approx(0.5)
    assert evaluate.macro_f1(counts).first()[0] == pytest.approx(4 / 9)


def plain_logistic(x, y, c):
    """Newton's method on the penalized loss, one model, densely."""
    x = np.c_[x, np.ones(len(x))]
    ridge = np.r_[np.full(x.shape[1] - 1, 1 / c), 1e-6]
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - 0.5 * np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
    return w


def test_models_equal_plain_ones(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3))
    labels = [sorted({int(k) for k in rng.integers(0, 4, 2)} | ({7} if r[0] > 0 else set())) for r in x]
    train = spark.createDataFrame([(i, r.tolist(), labels[i]) for i, r in enumerate(x)], "node long, vec array<double>, labels array<int>").repartition(3)
    for numbers in (4_000_000, 50):  # all models in one pass, or two
        monkeypatch.setattr(evaluate, "PASS_NUMBERS", numbers)
        got = {(r["node"], r["label"]): r["p"] for r in evaluate.one_vs_rest(train, train, [0, 1, 2, 3, 7, 9]).collect()}
        for label in (0, 1, 2, 3, 7):
            w = plain_logistic(x, np.array([label in s for s in labels], float), 1.0)
            want = 1 / (1 + np.exp(-np.c_[x, np.ones(80)] @ w))
            assert np.allclose([got[i, label] for i in range(80)], want, atol=1e-5)
        assert max(got[i, 9] for i in range(80)) < 1e-3  # nobody has it


def test_many_labels_and_splits(spark, monkeypatch):
    """The counts of classify equal those of topk and confusion on the same splits, with labels that never train and a split at a time."""
    rng = np.random.default_rng(2)
    vectors = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "node long, vec array<double>")
    truth = spark.createDataFrame([(i, int(k)) for i in range(60) for k in {i % 7, (i * i) % 11, 100 + i % 3}], "node long, label int")
    want = []
    for fraction in (0.3, 0.7):
        for repeat in range(2):
            part = evaluate.split_prefix(vectors, fraction, repeat)
            sets = truth.groupBy("node").agg(F.collect_set("label").alias("labels"))
            rows = vectors.join(sets, "node").join(part, "node")
            test = rows.filter("not train")
            names = [r[0] for r in truth.select("label").distinct().collect()]
            wanted = truth.join(test.select("node"), "node", "left_semi")
            counts = evaluate.confusion(evaluate.topk(evaluate.one_vs_rest(rows.filter("train"), test, names), wanted), wanted)
            want.append((fraction, evaluate.micro_f1(counts).first()[0], evaluate.macro_f1(counts).first()[0]))
    for numbers in (4_000_000, 60):
        monkeypatch.setattr(evaluate, "PASS_NUMBERS", numbers)
        got = {r["fraction"]: (r["micro_f1"], r["macro_f1"]) for r in evaluate.classify(vectors, truth, [0.3, 0.7], repeats=2).collect()}
        for f in (0.3, 0.7):
            assert got[f] == pytest.approx(tuple(np.mean([w[1:] for w in want if w[0] == f], axis=0)))


def test_truncated_steps_find_the_same_models(spark):
    """Correlated and badly scaled vectors, common, rare and missing labels: the weights of Newton's steps, of labels in any bands."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * np.array([1, 1, 10, 0.1, 1, 3])
    sets = [[k for k, one in enumerate((r[0] > 0, r[1] + rng.normal() > 2, i < 3, rng.random() < 0.5, False, True)) if one] for i, r in enumerate(x)]
    rows = spark.createDataFrame([(i, r.tolist(), s, [i % 4 > 0]) for i, (r, s) in enumerate(zip(x, sets, strict=True))], "node long, vec array<double>, labels array<long>, flags array<boolean>").repartition(3).persist()
    names = np.arange(6)
    want = evaluate.fit_logistic(rows, 6, names, 1, c=2.0)[0]
    basis = evaluate.spectrum(rows, 6, 2.0)
    assert np.allclose(evaluate.fit_truncated(rows, 6, names, basis, c=2.0), want, rtol=1e-4, atol=1e-4)
    assert np.allclose(evaluate.fit_truncated(rows, 6, names[2:4], basis, c=2.0), want[2:4], rtol=1e-4, atol=1e-4)
    rows.unpersist()


def test_more_labels_than_fit_a_pass(spark):
    """Each node has a label of its own and one of its group: bands of few labels give what one pass gives; repeated rows and null labels do no harm."""
    rng = np.random.default_rng(6)
    vectors = spark.createDataFrame([(i // 2, rng.normal(size=3).tolist()) for i in range(160)], "node long, vec array<double>")
    truth = spark.createDataFrame([(i, k) for i in range(80) for k in (None, -5 - i % 40, i % 3, i % 3)], "node long, label int")
    for numbers in (2000, 150):
        got, want = (evaluate.classify(vectors, truth, [0.6], numbers=x).first() for x in (numbers, None))
        assert tuple(got) == pytest.approx(tuple(want))
    assert evaluate.classify(vectors, truth.limit(0), [0.6], numbers=10).first()["micro_f1"] == 0.0


def test_alias_draws(spark):
    from meshvec.operators import stats

    edges = spark.createDataFrame([(0, 1, 1.0), (0, 2, 3.0), (0, 3, 6.0), (5, 0, 2.0)], "src long, dst long, w double")
    places = stats.alias_places(stats.alias_tables(stats.adjacency(edges)))
    rows = spark.range(30000).select(F.when(F.col("id") % 10 == 0, 5).when(F.col("id") % 10 == 1, 8).otherwise(0).cast("long").alias("node"), F.col("id").alias("draw"))
    got = {(r["node"], r["drawn"]): r["count"] for r in stats.alias_draw(rows, places, 3).groupBy("node", "drawn").count().collect()}
    assert got[5, 0] == 3000 and got[8, None] == 3000 and sum(got.values()) == 30000
    assert all(abs(got[0, n] / 24000 - p) < 0.01 for n, p in ((1, 0.1), (2, 0.3), (3, 0.6)))


def test_report_is_appended(spark, tmp_path):
    edges, labels = graphs.planted_partition(spark, 40, 2, 0.6, 0.05, 7)
    split = E.split_undirected(edges.filter("src < dst"), 2)
    for volume, directed in (("sum_weights", True), ("edge_count", False), ("line_count", False)):
        got = embeddings.evaluated(split, labels, 4, model="m", task="t", fractions=[0.3, 0.6], parties=2, repeats=2, window=2, per_edge=20, workers=1, rounds=2, directed=directed, volume=volume)
        graphs.append_results(got, str(tmp_path / "res"))
        assert not directed or all(r["micro_f1"] > 0.8 for r in got.collect())
    rows = spark.read.csv(str(tmp_path / "res"), header=True, inferSchema=True).collect()
    assert len(rows) == 6 and {r["communication"] for r in rows} == {2 * 40 * 8 * (2 + 2 * 4 * 5 + 4)} and all(r["seconds"] > 0 and r["parties"] == 2 for r in rows)


def test_streaming_degrees(spark, tmp_path):
    from meshvec.streaming.degrees import running_degrees

    spark.createDataFrame([(0, 1), (2, 1), (1, 0)], "src long, dst long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src long, dst long").parquet(str(tmp_path / "in"))
    q = running_degrees(stream).writeStream.format("memory").queryName("degrees").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("degrees").collect()} == {(1, 2), (0, 1)}


def test_products_are_added_up_in_cells(spark, monkeypatch):
    """Bands, sums in pieces and cells that several tasks share give the product; products never are rows of a join."""
    monkeypatch.setattr(matrix, "BAND", 5)
    monkeypatch.setattr(matrix, "AT_ONCE", 7)
    rng = np.random.default_rng(3)
    a, b = rng.integers(-2, 3, (12, 12)).astype(float), rng.integers(-2, 3, (12, 12)).astype(float)
    A, B = (spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "i long, j long, v double") for m in (a, b))
    for shared in (1 << 30, 40):
        monkeypatch.setattr(matrix, "SHARED", shared)
        got = matrix.dot(A, B)
        assert np.allclose(matrix.to_dense(got, 12), a @ b) and got.count() == (np.abs(a) @ np.abs(b) > 0).sum()
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
    assert matrix.dot(A.limit(0), B).count() == 0


def test_gram_of_equal_rows_is_unfolded(spark, monkeypatch):
    """Owners of equal rows, in several lists, each have their cells, and no cell is added up."""
    monkeypatch.setattr(matrix, "OWNERS", 3)
    a = np.zeros((30, 4))
    for i in range(30):
        a[i, [i % 3, 3] if i % 2 else [i % 3]] = 2.0
    A = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "i long, j long, v double")
    got = matrix.gram_of_rows(A)
    assert np.allclose(matrix.to_dense(got, 30), a @ a.T) and got.count() == (a @ a.T > 0).sum()
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_trade_is_counted_once(spark, sf_dir):
    """What stands on the trade of nations reads a checkpoint, not the tables again."""
    from meshvec.sources import graphs

    plan = graphs.nation_trade(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" not in plan and "Join" not in plan


def test_cells_out_of_reach_are_told_whatever_the_witness(spark):
    """A wrong middle node is made good by all others; only what no two edges join is lost."""
    from meshvec.plans import catalogue

    step = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 4), (2, 1, 4), (2, 4, 3)], "party int, src long, dst long")
    far = spark.createDataFrame([(1, 1, 3, 2), (1, 2, 4, 9), (1, 1, 4, 3), (2, 1, 3, 4), (2, 1, 2, 4)], "party int, i long, j long, k long")
    assert sorted(tuple(r) for r in catalogue.unreachable(far, step).collect()) == [(1, 1, 4), (2, 1, 2)]


def test_energy_adds_up_without_rounding(spark):
    from meshvec.plans import catalogue

    emb = spark.range(0, 300_000, 1, 1).selectExpr("array(8.049845, 0.1) AS vec")
    want = sum((300_000 * round(x * x, 18)) ** 2 for x in (8.049845, 0.1))
    assert abs(catalogue.energy(emb, 2).first()["energy"] - want) <= 1e-13 * want


def test_masked_messages_are_never_moved(spark, ab):
    """The masked proximity is made of packed blocks that meet once: no mask and no masked block is shuffled or broadcast."""
    a, b, A, B = ab
    a, b = np.abs(a), np.abs(b)
    deg = np.where((a + b).sum(0) > 0, (a + b).sum(0), 1.0)
    degree = spark.createDataFrame([(i, float(x)) for i, x in enumerate(deg)], "node long, deg double")
    xs = [coordinates(spark, x / deg[:, None]) for x in (a, b)]
    x = (a + b) / deg[:, None]
    for window, want in ((1, x / deg), (2, (x + x @ x) / deg / 2)):
        got = masks.masked_proximity(spark, xs, degree, 7.0, 12, window=window, size=5)
        assert np.allclose(matrix.to_dense(got, 12), 7 * want)
    plan = masks.demasked_sum([blocks.to_blocks(x, 5) for x in xs], 1.0, 12, size=5, seed=1, least=0.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 3  # the blocks of two parties, and what is done with them


def test_equal_rows_are_fitted_once(spark, monkeypatch):
    """Banded models see each kind of row once, and count as many of it as there are."""
    rng = np.random.default_rng(5)
    kinds = [(rng.normal(size=3).tolist(), [k % 3, 3 + k % 2]) for k in range(6)]
    kinds.append((kinds[0][0], [2, 3]))  # equal vectors of different labels
    rows = [(i, *kinds[i % 7]) for i in range(300)]
    vectors = spark.createDataFrame([r[:2] for r in rows], "node long, vec array<double>")
    truth = spark.createDataFrame([(i, x) for i, _, labels in rows for x in labels], "node long, label int")
    seen, fit = [], evaluate.fit_truncated
    monkeypatch.setattr(evaluate, "fit_truncated", lambda r, *a, **k: (seen.append(r.count()), fit(r, *a, **k))[1])
    want = evaluate.classify(vectors, truth, [0.4]).first()
    got = evaluate.classify(vectors, truth, [0.4], numbers=20).first()
    assert tuple(got) == pytest.approx(tuple(want)) and 0 < want["micro_f1"] < 1
    assert len(seen) == 2 and max(seen) <= 14


def test_pairs_are_drawn_once(spark):
    for frame in (graphs.random_symmetric(spark, 20, 1), graphs.planted_partition(spark, 20, 3, 0.5, 0.5, 5)[0]):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" not in plan and "conv(" not in plan


def shuffled_rows(spark, run):
    """What run returns, and the rows that its stages write to shuffles."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}

    before = written()
    out = run()
    return out, sum(n for k, n in written().items() if k not in before)


@pytest.mark.parametrize(("weighted", "directed"), [(True, True), (False, False)])
def test_samples_step_where_their_edges_are(spark, monkeypatch, weighted, directed):
    """Samples of window 2 are never rows of a shuffle (they were, each of them); nodes of few and many out-edges, dead ends and repeated edges give the cells that joined bins give."""
    rng = np.random.default_rng(5)
    edges = [(1, int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 6, 40), rng.integers(0, 9, 40), rng.integers(1, 5, 40), strict=True)] + [(2, 3, 4, 1.0), (2, 4, 5, 2.0), (2, 3, 4, 1.0)]
    held = spark.createDataFrame(edges, "party int, src long, dst long, w double")
    settings = {"window": 2, "per_edge": 4000, "workers": 1, "parties": 2, "weighted": weighted, "directed": directed}
    cells = lambda df: {(r["party"], r["i"], r["j"]): round(r["v"], 9) for r in df.collect()}
    got, rows = shuffled_rows(spark, lambda: cells(walks.path_samples(held, **settings)))
    assert rows < 5000  # of 43 * 2000 samples
    for hub in (0, 4):  # all nodes, or some
        monkeypatch.setattr(walks, "HUB", hub)
        assert got == cells(walks.path_samples(held, **settings))


def test_panels_meet_placed_cells(spark):
    """Products from both sides equal dense ones, and a multiplication shuffles a row for each part that has a node, not for each cell (half of the cells before)."""
    rng = np.random.default_rng(11)
    a = np.zeros((600, 600))
    a[:560, 560:] = rng.normal(size=(560, 40)) * (rng.random((560, 40)) < 0.9)  # few columns of many cells
    a += a.T
    cells, d = cut(coordinates(spark, a)), 3
    x = rng.normal(size=(600, d))
    y = cut(spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(600)], "i long, y array<double>"))
    placed = factor.Placed(cells, d)
    dense = lambda panel: np.array([r["y"] for r in sorted(panel.collect(), key=lambda r: r["i"])])
    assert np.allclose(dense(placed.dot(y, d)), a @ x)
    placed.dot(y, d, turned=True).count()  # what is persisted is filled
    got, rows = shuffled_rows(spark, lambda: dense(placed.dot(y, d, turned=True)))
    assert np.allclose(got, a.T @ x)
    assert rows < 600 + 2 * (560 + 40 * 4) + 600 < cells.count() / 10
    placed.release()


@pytest.mark.parametrize("stretch", [1, 60, 10**6])
def test_stretches_of_parts_give_the_product(spark, monkeypatch, stretch):
    """However many stretches a part has, and however few products are held at once, products from both sides equal dense ones; rows that no cell meets add nothing."""
    monkeypatch.setattr(factor, "STRETCH_NUMBERS", stretch)
    monkeypatch.setattr(factor, "AT_ONCE", 20)
    rng = np.random.default_rng(2)
    a = rng.normal(size=(50, 50)) * (rng.random((50, 50)) < np.r_[np.full(45, 0.05), np.full(5, 0.8)])
    a[7], a[:, 9] = 0, 0
    x = rng.normal(size=(50, 4))
    y = cut(spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(40)], "i long, y array<double>"))  # some nodes have no row
    x[40:] = 0
    placed = factor.Placed(coordinates(spark, a), 4)
    for turned, m in ((False, a), (True, a.T)):
        got = {r["i"]: r["y"] for r in placed.dot(y, 4, turned=turned).collect()}
        assert set(got) == set(np.flatnonzero(m.any(1)).tolist())
        assert all(np.allclose(got[i], m[i] @ x) for i in got)
    placed.release()


def test_tasks_hold_a_stretch(spark):
    """A worker's peak of memory hardly grows with the nodes of a part (1,500 to 75,000 nodes; it held the whole part before)."""
    sc, peaks = spark.sparkContext, []
    for n in (6_000, 300_000):
        sc.environment["MESHVEC_NODES"] = str(n)  # workers of their own
        star = spark.range(n).select("id", (-1 - F.col("id") % 5).alias("hub"), F.lit(1.0).alias("v"))
        cells = cut(star.select(F.col("id").alias("i"), F.col("hub").alias("j"), "v").unionByName(star.select(F.col("hub").alias("i"), F.col("id").alias("j"), "v")))
        y = cut(spark.range(-5, n).select(F.col("id").alias("i"), F.array_repeat(F.lit(1.0), 64).alias("y")))
        placed = factor.Placed(cells, 64)
        assert placed.dot(y, 64).agg(F.sum(F.get("y", F.lit(63)))).first()[0] == 2 * n
        placed.release()
        used = [Path(f"/proc/{p.pid}/status").read_text() for p in psutil.Process().children(recursive=True) if p.environ().get("MESHVEC_NODES") == str(n)]
        peaks.append(max(int(line.split()[1]) for status in used for line in status.splitlines() if line.startswith("VmHWM")) / 1024)
        del sc.environment["MESHVEC_NODES"]
    assert peaks[1] - peaks[0] < 100, peaks


@pytest.mark.parametrize("at_once", [7, 1 << 21])
def test_low_wide_cells_and_half_of_a_gram(spark, monkeypatch, at_once):
    """Short lines go to low and wide cells, with whole lines of the other side; half of a gram makes all of it. Values that are equal in a line travel once."""
    monkeypatch.setattr(matrix, "BAND", 8)
    monkeypatch.setattr(matrix, "AT_ONCE", at_once)
    rng = np.random.default_rng(5)
    a = np.where(rng.random((60, 300)) < 0.01, rng.integers(1, 4, (60, 1)), 0).astype(float)
    a[::3] *= 1 + np.arange(300)
    A = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "i long, j long, v double")
    rows, columns, made = matrix._shape(matrix.transpose(A), A)
    assert rows < 8 < columns and made == ((a != 0).sum(1) ** 2).sum()
    got = matrix.gram(A)
    assert np.allclose(matrix.to_dense(got, 300), a.T @ a) and got.count() == (a.T @ a != 0).sum()
    half = matrix.gram(A, mirrored=False)
    assert np.allclose(matrix.to_dense(half, 300), np.triu(a.T @ a)) and half.count() == (np.triu(a.T @ a) != 0).sum()
    assert np.allclose(matrix.to_dense(matrix.dot(matrix.transpose(A), A), 300), a.T @ a)


def test_cells_of_window_2_are_not_shuffled(spark, sf_dir):
    """After the last product's tasks nothing deals out or adds up its cells."""
    from meshvec.plans import catalogue

    plan = catalogue.QUERIES["prox_window2"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Aggregate" not in above and "Repartition" not in above and above.count("Join") == 1 and "Join Cross" not in above.replace("Join Inner", "")


def test_labelled_edges_need_no_join(spark, sf_dir):
    """A join by label would deal out every edge, as soon as nodes are too many for a broadcast."""
    from meshvec.plans import catalogue

    plan = catalogue.QUERIES["planted_partition"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_samples_are_checked_by_their_steps(spark):
    """Samples are never rows of a shuffle, and only cells without a path are lost, whatever step a walk says that it made."""
    from meshvec.plans import catalogue

    edge = [(1, a, b) for a, b in ((1, 2), (2, 3), (3, 4), (4, 5))]
    step = spark.createDataFrame([*edge, *[(p, b, a) for p, a, b in edge]], "party int, src long, dst long")
    rows = [(1, 2, 1, (1, 2)), (1, 3, 1, (2, 3)), (2, 4, 1, (2, 3)), (1, 4, 1, (3, 4)), (1, 4, 1, (1, 2)), (2, 4, 1, (9, 4)), (5, 1, 1, (2, 1))]
    sampled = spark.createDataFrame([(i, j, 0.5, p, o) for i, j, p, o in rows], "i long, j long, v double, party int, origin struct<i: long, j: long>")
    mass, lost = catalogue.checked_samples(sampled, step)
    assert [tuple(r) for r in mass.collect()] == [(1, 3.5)]
    assert sorted(tuple(r) for r in lost.collect()) == [(1, 1, 4), (1, 5, 1)]
    assert catalogue.checked_samples(sampled.filter("i < 3 and j < 4"), step)[1].count() == 0
    found = walks.path_samples(step.withColumn("w", F.lit(1.0)), window=2, per_edge=24, workers=2, parties=1, origin=True, summed=False)
    assert "Aggregate [i" not in found._jdf.queryExecution().optimizedPlan().toString()
    cells = lambda m: sorted((r["i"], r["j"], round(r["v"], 9)) for r in m.groupBy("i", "j").agg(F.sum("v").alias("v")).collect())
    assert cells(found) == cells(walks.path_samples(step.withColumn("w", F.lit(1.0)), window=2, per_edge=24, workers=2, parties=1))
    assert catalogue.checked_samples(found, step)[1].count() == 0
