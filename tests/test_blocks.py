"""Products of dense blocks on a grid, and the named block store."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from meshvec.operators import blocks, masks
from meshvec.plans import catalogue
from meshvec.sources import blockstore


def coordinates(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "i long, j long, v double")


def dense(frame, shape, size):
    out = np.zeros(shape)
    for r in blocks.from_blocks(frame, size).collect():
        out[r["i"], r["j"]] += r["v"]
    return out


@pytest.fixture(scope="module")
def pair(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(37, 53)), rng.normal(size=(53, 29))
    a[:, 8:20] = 0  # whole blocks are absent
    b[30:, :10] = 0
    return a, b, blocks.to_blocks(coordinates(spark, a), 4).cache(), blocks.to_blocks(coordinates(spark, b), 4).cache()


@pytest.mark.parametrize("band, inner", [(1, 1), (2, 3), (3, 100), (100, 100)])
def test_grid_product(pair, band, inner):
    a, b, x, y = pair
    assert np.allclose(dense(blocks.dot(x, y, 4, band=band, inner=inner), (37, 29), 4), a @ b)


def test_grid_product_of_nothing(spark, pair):
    none = spark.createDataFrame([], blocks.DDL)
    assert blocks.dot(pair[2], none, 4).count() == 0 and blocks.dot(none, pair[3], 4).count() == 0


def test_blocks_go_once_to_each_cell_that_needs_them(pair, monkeypatch):
    """With 4 bands a side a block goes to at most 4 cells, and absent partners ask for none."""
    seen = {}
    monkeypatch.setattr(blocks, "summed", lambda parts, width: seen.setdefault("plan", parts))
    a, b, x, y = pair
    blocks.dot(x, y, 4, band=3, inner=100)
    plan = seen["plan"]._jdf.queryExecution().optimizedPlan()
    assert "Union" in plan.toString()
    columns = {(r["bi"], r["bj"] // 3) for r in y.collect()}
    rows = {(r["bj"], r["bi"] // 3) for r in x.collect()}
    sent = sum(len({g for k, g in columns if k == r["bj"]}) for r in x.collect()) + sum(len({g for k, g in rows if k == r["bi"]}) for r in y.collect())
    assert sent <= x.count() * 3 + y.count() * 4


def test_store_is_read_without_exchange(spark, pair, tmp_path):
    a, b, x, y = pair
    blockstore.save(x, str(tmp_path), "left", 4, inner="bj", buckets=4)
    blockstore.save(y, str(tmp_path), "right", 4, inner="bi", buckets=4)
    left, right = (blockstore.load(spark, str(tmp_path), n) for n in ("left", "right"))
    assert np.allclose(dense(blocks.dot_stored(left, right, 4), (37, 29), 4), a @ b)
    joined = left.alias("l").join(right.hint("merge").alias("r"), left["bj"] == right["bi"])
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    one = blockstore.line(right, "bi", 2)
    setting = "spark.sql.sources.bucketing.autoBucketedScan.enabled"  # with it buckets are pruned, too, but the plan's text doesn't tell
    spark.conf.set(setting, "false")
    try:
        assert "SelectedBucketsCount: 1 out of 4" in blockstore.line(right, "bi", 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(setting)
    got = dense(one, (53, 29), 4)
    assert np.allclose(got[8:12], b[8:12]) and not got[:8].any() and not got[12:].any()
    told = blockstore.manifest(spark, str(tmp_path), "right")
    assert (told["size"], told["inner"], told["buckets"], told["n_rows"], told["n_columns"]) == (4, "bi", 4, 14, 8)


def test_store_has_versions_and_opens_in_another_session(spark, pair, tmp_path):
    a, b, x, y = pair
    blockstore.save(x, str(tmp_path), "m", 4, inner="bj", buckets=2)
    first = blockstore.load(spark, str(tmp_path), "m")
    blockstore.save(y, str(tmp_path), "m", 4, inner="bi", buckets=3)
    assert np.allclose(dense(first, a.shape, 4), a)  # a reader of the version before keeps it
    other = spark.newSession()
    assert np.allclose(dense(blockstore.load(other, str(tmp_path), "m"), b.shape, 4), b)
    assert blockstore.manifest(other, str(tmp_path), "m")["buckets"] == 3
    spark.sql("SHOW TABLES").filter("tableName like 'blocks_%'").collect()


def test_store_without_blocks_and_without_name(spark, tmp_path):
    blockstore.save(spark.createDataFrame([], blocks.DDL), str(tmp_path), "none", 4, inner="bi", buckets=2)
    assert blockstore.load(spark, str(tmp_path), "none").count() == 0
    assert blockstore.manifest(spark, str(tmp_path), "none")["n_rows"] == 0
    with pytest.raises(FileNotFoundError):
        blockstore.load(spark, str(tmp_path), "never")
    with pytest.raises(ValueError):
        blockstore.save(spark.createDataFrame([], blocks.DDL), str(tmp_path), "none", 4, inner="x")


def test_thin_blocks_are_packed(spark):
    """A block of few cells is as long as its cells need, whatever was done to it; dense ones are whole."""
    a = np.zeros((24, 24))
    a[1, 2], a[9, 20], a[16:, 16:] = 3.0, -2.0, np.arange(1, 65).reshape(8, 8)
    x = blocks.to_blocks(coordinates(spark, a), 8)
    for m, want in ((x, a), (blocks.transpose(x, 8), a.T), (blocks.add(8, (1, x), (-2.5, x)), -1.5 * a), (blocks.dot(x, x, 8), a @ a)):
        assert np.allclose(dense(m, (24, 24), 8), want)
        assert {len(r["x"]) for r in m.collect()} <= {0, 2, 16, 64}


def test_masks_are_not_broadcast(spark, pair):
    p = masks.orthogonal_blocks(spark, 53, 4, 1)
    plan = blocks.dot(pair[2], p, 4)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_row_groups_of_a_store_are_small(spark, tmp_path):
    blockstore.save(masks.orthogonal_blocks(spark, 64 * 1500, 64, 1), str(tmp_path), "m", 64, inner="bi", buckets=1)
    files = list(tmp_path.rglob("blocks_0/*.parquet"))
    groups = [g.total_byte_size for f in files for g in (pq.read_metadata(f).row_group(k) for k in range(pq.read_metadata(f).num_row_groups))]
    assert len(groups) > 1 and max(groups) < 2 * blockstore.GROUP_BYTES


def test_a_block_row_needs_one_store(spark, sf_dir, monkeypatch):
    saved, save = [], blockstore.save
    monkeypatch.setattr(blockstore, "save", lambda *a, **k: (saved.append(a[2]), save(*a, **k)))
    catalogue.QUERIES["stored_block_row"](spark, sf_dir)
    assert saved == ["own"]


def test_wide_cells_need_no_sums_after_them(spark, pair, monkeypatch):
    """The grid's cells are as wide as sums may be, and one task makes a block, with what is added to it; a grid of few cells shares the inner index."""
    a, b, x, y = pair
    monkeypatch.setattr(blocks, "AT_ONCE", 5)
    monkeypatch.setattr(blocks, "SUMS", 16 * 4 * 4)
    twice = []
    summed = blocks.summed
    monkeypatch.setattr(blocks, "summed", lambda *of: (twice.append(1), summed(*of))[1])
    c = np.zeros((37, 29))
    c[3, 4], c[36, 28], c[9] = 2.0, 1.0, 1.0
    z = blocks.to_blocks(coordinates(spark, c), 4)
    for uses in (0, 32, 1 << 30):  # dense, as the cells are, one by one
        monkeypatch.setattr(blocks, "USES", uses)
        got = blocks.dot(x, y, 4, plus=((-2, z),))
        assert np.allclose(dense(got, (37, 29), 4), a @ b - 2 * c) and not twice
        rows = [(r["bi"], r["bj"]) for r in got.select("bi", "bj").collect()]
        assert len(rows) == len(set(rows))
    monkeypatch.setattr(blocks, "SUMS", 1 << 25)
    monkeypatch.setattr(blocks, "INNER", 3)
    assert np.allclose(dense(blocks.dot(x, y, 4, plus=((0.5, z),)), (37, 29), 4), a @ b + 0.5 * c) and twice


def test_cells_listed_again_make_one_block(spark):
    rows = [(1, 2, float(k % 3)) for k in range(40)] + [(5, 5, 1.0)] * 3
    m = blocks.to_blocks(spark.createDataFrame(rows, "i long, j long, v double"), 3)
    want = np.zeros((6, 6))
    want[1, 2], want[5, 5] = sum(k % 3 for k in range(40)), 3
    assert m.count() == 2 and np.allclose(dense(m, (6, 6), 3), want)


def test_masked_square_moves_no_dense_block(spark, monkeypatch):
    """Window 2 under masks equals the plain square, over several cells of the grid; only blocks with the parties' own cells travel."""
    n, size = 23, 4
    monkeypatch.setattr(blocks, "SUMS", (2 * size) ** 2)
    rng = np.random.default_rng(8)
    own = [np.where(rng.random((n, n)) < 0.1, rng.random((n, n)), 0) for _ in range(2)]
    own[0][9:], own[1][:, 15:] = 0, 0
    ys = [x * 3 for x in own]
    of = lambda m: blocks.to_blocks(coordinates(spark, m), size)
    got = masks.masked_square_sum([of(x) for x in own], [of(y) for y in ys], 0.5, n, size=size, seed=4, least=1e-9)
    cells = np.zeros((n, n))
    rows = got.collect()
    for r in rows:
        cells[r["i"], r["j"]] += r["v"]
    want = 0.5 * (sum(ys) + sum(own) @ sum(ys))
    assert np.allclose(cells, want, atol=1e-8) and len(rows) == (np.abs(want) > 1e-9).sum()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan.splitlines()[0]  # what the tasks make of a block is the result
