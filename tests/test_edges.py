import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshvec.functions.columns import tile
from meshvec.functions.lineage import global_rank
from meshvec.operators import edges as E
from meshvec.operators import stats
from meshvec.sources import graphs, matfiles

TINY = [(0, 1), (1, 0), (1, 2), (1, 2), (3, 3), (2, 4)]


@pytest.fixture
def tiny(spark):
    return spark.createDataFrame(TINY, "src long, dst long")


def pairs(df):
    return sorted((r[0], r[1]) for r in df.select("src", "dst").collect())


def test_canonical_and_symmetric(tiny):
    assert pairs(E.canonical(tiny)) == [(0, 1), (1, 2), (2, 4), (3, 3)]
    assert pairs(E.symmetrize(E.canonical(tiny))).count((3, 3)) == 2


def test_self_loops_and_isolated(spark, tiny):
    assert [tuple(r) for r in E.self_loops(tiny).collect()] == [(3, 1)]
    assert sorted(r[0] for r in E.isolated(tiny, spark.range(7).withColumnRenamed("id", "node")).collect()) == [5, 6]


@pytest.mark.parametrize("n,k", [(10, 3), (3, 5), (7, 7), (1, 2), (0, 2)])
def test_split_is_near_equal(spark, n, k):
    split = E.split_parties(spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long"), k)
    sizes = Counter(r["party"] for r in split.collect())
    assert sum(sizes.values()) == n
    assert sorted(sizes.values(), reverse=True) == [x for x in (n // k + (i < n % k) for i in range(k)) if x]


def test_tile_equals_ntile(spark):
    for n, k in ((11, 4), (2, 3), (9, 3)):
        df = spark.range(1, n + 1).select("id", tile(F.col("id"), F.lit(n), k).alias("mine"))
        want = spark.range(1, n + 1).selectExpr("id", f"ntile({k}) over (order by id) as theirs")
        assert df.join(want, "id").filter("mine != theirs").count() == 0


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    ranked = global_rank(df.repartition(5), ["x"])
    assert [r["rank"] for r in ranked.orderBy("x").collect()] == list(range(1, 1001))
    assert ranked.select("n").distinct().collect()[0][0] == 1000


def test_party_repeats(spark):
    split = spark.createDataFrame([(0, 1, 1), (0, 1, 1), (0, 1, 2)], "src long, dst long, party int")
    merged = E.merge_parties(E.party_edges(split)).collect()
    assert [tuple(r) for r in merged] == [(0, 1, 2.0)]  # repeats inside a party collapse, across parties they add


def test_degrees_do_not_depend_on_parties(spark, sf_dir):
    edges = graphs.part_supp(spark, sf_dir)
    for k in (2, 3):
        by_party = stats.in_degree(E.party_edges(E.split_parties(edges, k)), ("party",))
        assert stats.global_degree(by_party).exceptAll(stats.in_degree(edges)).count() == 0


def test_volume_modes(tiny):
    assert [stats.volume(tiny, m).first()[0] for m in ("sum_weights", "edge_count", "line_count")] == [6.0, 4.0, 6.0]
    with pytest.raises(ValueError):
        stats.volume(tiny, "other")


def test_alias_table_draws_its_weights():
    for weights in ([1.0], [1.0, 3.0, 6.0], [5.0, 5.0], [0.1, 0.2, 0.3, 9.4]):
        j, q = stats.alias_table(weights)
        p = [0.0] * len(weights)
        for i in range(len(weights)):
            p[i] += q[i] / len(weights)
            p[j[i]] += (1 - q[i]) / len(weights)
        assert p == pytest.approx([w / sum(weights) for w in weights])


def test_files(spark, tmp_path, tiny):
    graphs.write_parties(E.split_parties(tiny, 2), str(tmp_path / "parts"))
    back = spark.read.csv(str(tmp_path / "parts"), sep=" ", schema="src long, dst long, party int")
    assert pairs(back) == sorted(TINY)
    (tmp_path / "one.txt").write_text("1 2\n3 45")
    assert pairs(graphs.read_edge_list(spark, str(tmp_path / "one.txt"))) == [(1, 2), (3, 45)]
    emb = spark.createDataFrame([(1, [0.5, 1.0])], "node long, vec array<double>")
    graphs.write_embedding(emb, str(tmp_path / "emb"))
    assert spark.read.parquet(str(tmp_path / "emb")).collect() == emb.collect()
    result = spark.createDataFrame([("m", 0.5)], "model string, micro_f1 double")
    for _ in range(2):
        graphs.append_results(result, str(tmp_path / "res"))
    assert spark.read.csv(str(tmp_path / "res"), header=True).count() == 2


def mat_element(kind, data, padded=True):
    return np.array([kind, len(data)], "<u4").tobytes() + data + bytes(-len(data) % 8 if padded else 0)


def mat_matrix(name, a, sparse):
    """A matrix element of a MATLAB file, column by column."""
    flags = mat_element(6, np.array([(5 if sparse else 6), a.size], "<u4").tobytes())
    head = flags + mat_element(5, np.array(a.shape, "<i4").tobytes()) + (np.array([len(name) << 16 | 1], "<u4").tobytes() + name.encode().ljust(4, b"\0") if len(name) <= 4 else mat_element(1, name.encode()))
    if not sparse:
        return mat_element(14, head + mat_element(9, a.T.astype("<f8").tobytes()))
    j, i = np.nonzero(a.T)
    starts = np.searchsorted(j, np.arange(a.shape[1] + 1))
    return mat_element(14, head + mat_element(5, i.astype("<i4").tobytes()) + mat_element(5, starts.astype("<i4").tobytes()) + mat_element(9, a[i, j].astype("<f8").tobytes()))


@pytest.mark.parametrize("sparse", [True, False])
@pytest.mark.parametrize("packed", [True, False])
def test_matlab_networks(spark, tmp_path, sparse, packed):
    rng = np.random.default_rng(3)
    a = rng.integers(1, 9, (7, 5)) * (rng.random((7, 5)) < 0.4)
    body = [mat_matrix("g", np.ones((2, 2)), False), mat_matrix("network", a.astype(float), sparse)]
    if packed:
        body = [mat_element(15, zlib.compress(x), padded=False) for x in body]
    (tmp_path / "x.mat").write_bytes(b"MATLAB 5.0 MAT-file".ljust(124) + b"\x00\x01IM" + b"".join(body))
    got = {(r["i"], r["j"]): r["v"] for r in matfiles.read_network(spark, str(tmp_path / "x.mat")).collect()}
    assert got == {(i, j): a[i, j] for i, j in zip(*np.nonzero(a), strict=True)}
    assert matfiles.read_network(spark, str(tmp_path / "x.mat"), "g").count() == 4
    with pytest.raises(ValueError, match="no matrix other"):
        list(matfiles.pieces((tmp_path / "x.mat").read_bytes(), "other"))
    with pytest.raises(ValueError, match="ends inside"):
        list(matfiles.pieces((tmp_path / "x.mat").read_bytes()[:-40], "network"))


def write_mat(path, *bodies, packed):
    path.write_bytes(b"MATLAB 5.0 MAT-file".ljust(124) + b"\x00\x01IM" + b"".join(mat_element(15, zlib.compress(x), padded=False) if packed else x for x in bodies))


@pytest.mark.parametrize("sparse", [True, False])
@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("cells", [1, 7, 64])
def test_matlab_pieces(tmp_path, monkeypatch, sparse, packed, cells):
    """Pieces of any size give the same cells: empty columns, a column of many pieces, an empty matrix, inflated a few bytes at a time."""
    monkeypatch.setattr(matfiles, "CELLS", cells)
    monkeypatch.setattr(matfiles, "INFLATED", 13)
    rng = np.random.default_rng(5)
    a = rng.integers(1, 300, (40, 9)) * (rng.random((40, 9)) < 0.3) * np.array([0, 1, 1, 0, 0, 1, 1, 1, 0])
    a[:, 5] = 7
    for one in (a, a * 0):
        write_mat(tmp_path / "x.mat", mat_matrix("longer name", one, not sparse), mat_matrix("network", one.astype(float), sparse), packed=packed)
        rows = {}
        for piece, role, form, runs, data in matfiles.pieces((tmp_path / "x.mat").read_bytes(), "network"):
            rows.setdefault(piece, []).append({"role": role, "form": form, "runs": runs, "data": data})
        assert all(len(np.frombuffer(r["data"], r["form"])) <= cells for rs in rows.values() for r in rs)
        got = [c for rs in rows.values() for c in matfiles._coordinates(matfiles.pa.Table.from_pylist(rs)).to_pylist()]
        assert sorted((c["i"], c["j"], c["v"]) for c in got) == sorted((i, j, one[i, j]) for i, j in zip(*np.nonzero(one), strict=True))


def test_a_file_is_read_by_several_tasks(spark, tmp_path):
    """Two million cells in a deflated file: coordinates are made by more than one task."""
    n, per = 20_000, 100
    i = (np.arange(n)[:, None] * 7 + np.arange(per) * 131) % n
    i.sort(axis=1)
    head = mat_element(6, np.array([5, n * per], "<u4").tobytes()) + mat_element(5, np.array([n, n], "<i4").tobytes()) + mat_element(1, b"network")
    body = head + mat_element(5, i.astype("<i4").tobytes()) + mat_element(5, (np.arange(n + 1) * per).astype("<i4").tobytes()) + mat_element(2, (i % 5 + 1).astype("u1").tobytes())
    write_mat(tmp_path / "x.mat", mat_element(14, body), packed=True)
    cells = matfiles.read_network(spark, str(tmp_path / "x.mat"))
    got = cells.groupBy(F.spark_partition_id().alias("task")).agg(F.count("v").alias("n"), F.sum("i").alias("i"), F.sum("j").alias("j"), F.sum("v").alias("v"), F.sum(F.col("i") * F.col("j") % 1009).alias("ij")).collect()
    assert len(got) > 1
    total = [sum(r[c] for r in got) for c in ("n", "i", "j", "v", "ij")]
    j = np.arange(n)[:, None]
    assert total == [n * per, i.sum(), j.sum() * per, (i % 5 + 1).sum(), (i * j % 1009).sum()]


def test_bad_lines_of_an_edge_list(spark, tmp_path):
    (tmp_path / "e.txt").write_text("1 2\n3\n\n 4 5 \n6 x\n7 8 9\n-1 +2\n99999999999999999999 1\n1.5 2\n")
    path = str(tmp_path / "e.txt")
    assert sorted(tuple(r) for r in graphs.read_edge_list(spark, path, bad="drop").collect()) == [(-1, 2), (1, 2), (4, 5)]
    rows = graphs.rejected_lines(spark, path).collect()
    assert sorted(r["line"] for r in rows) == ["", "1.5 2", "3", "6 x", "7 8 9", "99999999999999999999 1"]
    assert all(r["file"].endswith("e.txt") and r["block"] == 0 for r in rows)
    with pytest.raises(Exception, match="not an edge: 3 "):
        graphs.read_edge_list(spark, path, bad="fail").collect()
    with pytest.raises(ValueError):
        graphs.read_edge_list(spark, path, bad="skip")
