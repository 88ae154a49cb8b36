"""The queries by name, each over whole tables, with SQL for those that SQL can express.

Compared floats are rounded to 6 digits on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshvec.functions.columns import md5_uniform, mix_key, rounded
from meshvec.functions.lineage import cut, shared_folder
from meshvec.operators import edges as E
from meshvec.operators import blocks, evaluate, factor, masks, matrix, proximity, stats, walks
from meshvec.plans import embeddings
from meshvec.sources import blockstore, graphs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PARTIES, PER_EDGE, WORKERS = 3, 500, 8
#: Side of a dense block: 512 KB.
BLOCK = 256


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def vals(df: DataFrame, *names: str) -> DataFrame:
    """df with the named float columns rounded."""
    return df.withColumns({n: rounded(F.col(n)) for n in names or ("v",)})


PS = "ps AS (SELECT DISTINCT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem)"
CS = "cs AS (SELECT DISTINCT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
#: Raw lines of an undirected list with self-loops and repeats: part and supplier numbers taken as nodes of one kind.
RAW = "raw AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem)"
CANON = RAW + ", canon AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM raw)"
KEY = "(src * 7919 + dst * 104729) % 1000003"
SPLIT = f"split AS (SELECT src, dst, CAST(ntile({PARTIES}) OVER (ORDER BY {KEY}, src, dst) AS INTEGER) AS party FROM ps)"
#: The lines of part_supp, split with their repeats.
LINES = "lines AS (SELECT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst, l_orderkey, l_linenumber FROM lineitem)"
LINE_SPLIT = LINES + f", lsplit AS (SELECT src, dst, CAST(ntile({PARTIES}) OVER (ORDER BY {KEY}, src, dst, l_orderkey, l_linenumber) AS INTEGER) AS party FROM lines)"
TRADE = """
tp AS (SELECT CAST(c_nationkey AS BIGINT) AS i, CAST(s_nationkey AS BIGINT) AS j, CAST(o_orderkey % 2 + 1 AS INTEGER) AS party, CAST(count(*) AS DOUBLE) AS v
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
t AS (SELECT i, j, sum(v) AS v FROM tp GROUP BY i, j),
d AS (SELECT j AS node, sum(v) AS deg FROM t GROUP BY j),
vol AS (SELECT sum(v) AS vol FROM t),
x AS (SELECT t.i, t.j, t.v / d.deg AS v FROM t JOIN d ON t.i = d.node),
xp AS (SELECT tp.i, tp.j, tp.party, tp.v / d.deg AS v FROM tp JOIN d ON tp.i = d.node)"""
SYM_CS = CS + ", e AS (SELECT src, dst FROM cs UNION ALL SELECT dst, src FROM cs), d AS (SELECT dst AS node, count(*)::DOUBLE AS deg FROM e GROUP BY dst), vol AS (SELECT count(*)::DOUBLE AS vol FROM e)"
SYM_PS = PS + ", e AS (SELECT src, dst FROM ps UNION ALL SELECT dst, src FROM ps), d AS (SELECT dst AS node, count(*)::DOUBLE AS deg FROM e GROUP BY dst), vol AS (SELECT count(*)::DOUBLE AS vol FROM e)"


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.nation_trade(spark, sf_dir).groupBy("i", "j").agg(F.sum("v").alias("v"))


def trade_degree(t: DataFrame) -> DataFrame:
    return t.groupBy(F.col("j").alias("node")).agg(F.sum("v").alias("deg"))


def split_part_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.split_parties(graphs.part_supp(spark, sf_dir), PARTIES)


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.split_parties(graphs.part_supp_lines(spark, sf_dir), PARTIES, ties=("l_orderkey", "l_linenumber")).select("src", "dst", "party")


# Edges and parties.


@query(f"WITH {PS} SELECT src, dst FROM ps")
def edges_distinct(spark, sf_dir):
    return graphs.part_supp(spark, sf_dir)


@query(f"WITH {CANON} SELECT src, dst FROM canon")
def edges_canonical(spark, sf_dir):
    return E.canonical(raw_lines(spark, sf_dir))


@query(f"WITH {CANON} SELECT src, dst FROM canon UNION ALL SELECT dst, src FROM canon")
def edges_symmetrize(spark, sf_dir):
    return E.symmetrize(E.canonical(raw_lines(spark, sf_dir)))


@query(f"WITH {RAW} SELECT src AS node, count(*) AS n FROM raw WHERE src = dst GROUP BY src")
def edges_self_loops(spark, sf_dir):
    return E.self_loops(raw_lines(spark, sf_dir))


@query(f"WITH {RAW} SELECT count(*) AS n_lines, count(DISTINCT (src, dst)) AS n_distinct FROM raw")
def edges_line_count(spark, sf_dir):
    return raw_lines(spark, sf_dir).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("n_distinct"))


@query(f"WITH {PS}, {SPLIT} SELECT src, dst, party FROM split")
def party_split(spark, sf_dir):
    return split_part_supp(spark, sf_dir)


@query(f"WITH {CANON}, split AS (SELECT src, dst, CAST(ntile({PARTIES}) OVER (ORDER BY {KEY}, src, dst) AS INTEGER) AS party FROM canon) SELECT src, dst, party FROM split UNION ALL SELECT dst, src, party FROM split")
def party_split_undirected(spark, sf_dir):
    return E.split_undirected(raw_lines(spark, sf_dir), PARTIES)


@query("SELECT (l_partkey * 2) || ',' || (l_suppkey * 2 + 1) AS line, count(*) AS n FROM lineitem WHERE l_linenumber = 3 GROUP BY ALL UNION ALL SELECT 'edges', count(*) FROM lineitem WHERE l_linenumber <> 3")
def rejected_edge_lines(spark, sf_dir):
    """Line items as lines of text, those with number 3 with a comma: the lines that a reader of edges rejects, and how many edges it finds."""
    path, lines = new_folder(spark), graphs.part_supp_lines(spark, sf_dir)
    sep = F.when(F.col("l_linenumber") == 3, ",").otherwise(" ")
    lines.select(F.concat(F.col("src").cast("string"), sep, F.col("dst").cast("string")).alias("value")).write.text(path)
    bad = graphs.rejected_lines(spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    return bad.unionByName(graphs.read_edge_list(spark, path, bad="drop").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("line"), "n"))


@query(f"WITH {LINE_SPLIT} SELECT party, count(*) AS n_lines, count(DISTINCT (src, dst)) AS n_edges FROM lsplit GROUP BY party")
def party_edge_counts(spark, sf_dir):
    by_edge = split_lines(spark, sf_dir).groupBy("party", "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return by_edge.groupBy("party").agg(F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("n_edges"))


@query(f"WITH {LINE_SPLIT}, held AS (SELECT DISTINCT src, dst, party FROM lsplit) SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM held GROUP BY src, dst HAVING count(*) > 1")
def party_cross_duplicates(spark, sf_dir):
    return E.merge_parties(E.party_edges(split_lines(spark, sf_dir))).filter("w > 1")


@query(f"WITH {CS} SELECT c_custkey * 2 AS node FROM customer WHERE NOT EXISTS (SELECT 1 FROM cs WHERE cs.src = c_custkey * 2)")
def isolated_nodes(spark, sf_dir):
    universe = graphs.table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("node"))
    return E.isolated(graphs.cust_supp(spark, sf_dir), universe)


@query(f"WITH {CS}, d AS (SELECT src AS node, count(*)::DOUBLE AS deg FROM cs GROUP BY src) SELECT c_custkey * 2 AS node, coalesce(deg, 0.0) AS deg FROM customer LEFT JOIN d ON node = c_custkey * 2")
def padded_degrees(spark, sf_dir):
    universe = graphs.table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("node"))
    reverse = graphs.cust_supp(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return E.pad_nodes(stats.in_degree(reverse), universe, "deg")


@query("WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events)) SELECT DISTINCT code * 2 + 1 AS node FROM k WHERE code * 2 + 1 NOT IN (SELECT user_id * 2 FROM events)")
def dead_ends(spark, sf_dir):
    edges = graphs.user_events(spark, sf_dir)
    return edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


# Files, in a folder of their own below the shared one.


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query(f"WITH {PS}, {SPLIT} SELECT src, dst, party FROM split")
def edge_list_files(spark, sf_dir):
    """The parties' edges written as text and read again."""
    path = new_folder(spark)
    graphs.write_parties(split_part_supp(spark, sf_dir), path)
    return graphs.read_edge_list(spark, path)


@query("SELECT vec_id AS node, CAST(k AS BIGINT) AS k, round(v, 5) AS v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)")
def embedding_files(spark, sf_dir):
    """Node vectors written as an embedding and read again."""
    path = new_folder(spark)
    graphs.write_embedding(graphs.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vec")), path)
    cells = spark.read.parquet(path).select("node", F.posexplode("vec").alias("k", "v"))
    return cells.select("node", F.col("k").cast("long").alias("k"), rounded(F.col("v").cast("double"), 5).alias("v"))


# Degrees, volumes, neighbour lists.


@query(f"WITH {SYM_CS} SELECT node, deg FROM d")
def degree_in(spark, sf_dir):
    return stats.in_degree(E.symmetrize(graphs.cust_supp(spark, sf_dir)))


@query(f"WITH {LINE_SPLIT}, held AS (SELECT DISTINCT src, dst, party FROM lsplit) SELECT dst AS node, CAST(count(*) AS DOUBLE) AS deg FROM held GROUP BY dst")
def degree_global_by_party(spark, sf_dir):
    return stats.global_degree(stats.in_degree(E.party_edges(split_lines(spark, sf_dir)), ("party",)))


@query(f"""WITH {RAW} SELECT 'sum_weights' AS mode, CAST(count(*) AS DOUBLE) AS vol FROM (SELECT DISTINCT src, dst FROM raw)
UNION ALL SELECT 'edge_count', CAST(count(*) AS DOUBLE) FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM raw)
UNION ALL SELECT 'line_count', CAST(count(*) AS DOUBLE) FROM raw""")
def volume_modes(spark, sf_dir):
    raw = raw_lines(spark, sf_dir)
    parts = [stats.volume(raw.distinct() if m == "sum_weights" else raw, m).select(F.lit(m).alias("mode"), "vol") for m in ("sum_weights", "edge_count", "line_count")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {CS} SELECT src AS node, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours FROM cs GROUP BY src")
def adjacency_lists(spark, sf_dir):
    return stats.adjacency(graphs.cust_supp(spark, sf_dir)).select("node", F.array_join("neighbours", ",").alias("neighbours"))


@query(f"WITH {TRADE} SELECT i AS node, string_agg(j || ':' || CAST(v AS BIGINT), ',' ORDER BY j) AS weights FROM t GROUP BY i")
def node_weight_map(spark, sf_dir):
    edges = trade(spark, sf_dir).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("v").alias("w"))
    pairs = F.transform(F.array_sort(F.map_entries("weights")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("long").cast("string")))
    return stats.weight_map(edges).select("node", F.array_join(pairs, ",").alias("weights"))


@query(f"WITH {TRADE} SELECT i AS node, j AS neighbour, round(v / sum(v) OVER (PARTITION BY i), 6) AS p FROM t")
def alias_probabilities(spark, sf_dir):
    edges = trade(spark, sf_dir).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("v").alias("w"))
    return vals(stats.alias_probabilities(stats.alias_tables(stats.adjacency(edges))), "p")


@query(f"WITH {TRADE} SELECT i AS node, j AS neighbour, true AS near FROM t")
def alias_draw(spark, sf_dir):
    """Every neighbour and whether it comes as often in 20,000 draws of its node as its weight asks for, within 0.02. Nothing else is drawn."""
    edges = trade(spark, sf_dir).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("v").alias("w"))
    adj = stats.adjacency(edges)
    draws = adj.select("node", F.explode(F.sequence(F.lit(1), F.lit(20000))).alias("s")).select("node", F.xxhash64("node", "s").alias("draw"))
    drawn = stats.alias_draw(draws, stats.alias_places(stats.alias_tables(adj)), 7).groupBy("node", F.col("drawn").alias("neighbour")).agg((F.count(F.lit(1)) / 20000).alias("share"))
    total = edges.groupBy("src").agg(F.sum("w").alias("s"))
    wanted = edges.join(total, "src").select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), (F.col("w") / F.col("s")).alias("p"))
    both = wanted.join(drawn, ["node", "neighbour"], "full")
    return both.select("node", "neighbour", (F.abs(F.coalesce("share", F.lit(0.0)) - F.coalesce("p", F.lit(-1.0))) < 0.02).alias("near"))


@query("""WITH c AS (SELECT l_suppkey * 2 + 1 AS node, l_partkey * 2 AS neighbour, count(*)::DOUBLE AS w FROM lineitem GROUP BY ALL)
SELECT node, neighbour, w AS lines FROM c""")
def hub_alias_probabilities(spark, sf_dir):
    """How often tables of two levels draw each of a supplier's parts in as many draws as it has lines; chunks of 64, so that every supplier has several."""
    edges = graphs.part_supp_lines(spark, sf_dir).groupBy(F.col("dst").alias("src"), F.col("src").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    total = edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("total"))
    found = stats.hub_alias_probabilities(*stats.hub_alias_tables(edges, 64)).join(total, "node")
    return vals(found.select("node", "neighbour", (F.col("p") * F.col("total")).alias("lines")), "lines")


# Matrix algebra.


@query(f"WITH {PS} SELECT src AS i, dst AS j, CAST(src // 64 AS BIGINT) AS bi, CAST(dst // 64 AS BIGINT) AS bj FROM ps")
def block_ids(spark, sf_dir):
    return matrix.with_blocks(matrix.from_edges(graphs.part_supp(spark, sf_dir)), 64).select("i", "j", "bi", "bj")


@query(f"WITH {PS} SELECT CAST(src // 64 AS BIGINT) AS bi, CAST(dst // 64 AS BIGINT) AS bj, count(*) AS nnz, CAST(count(*) AS DOUBLE) AS total FROM ps GROUP BY ALL")
def block_nnz(spark, sf_dir):
    return matrix.block_counts(matrix.from_edges(graphs.part_supp(spark, sf_dir)), 64)


@query(f"WITH {PS} SELECT src AS i, dst AS j, 1.0::DOUBLE AS v FROM ps WHERE src // 64 = dst // 64")
def block_diagonal(spark, sf_dir):
    return matrix.block_diagonal(matrix.from_edges(graphs.part_supp(spark, sf_dir)), 64)


@query(f"WITH {CS} SELECT a.dst AS i, b.dst AS j, CAST(count(*) AS DOUBLE) AS v FROM cs a JOIN cs b ON a.src = b.src GROUP BY ALL")
def mat_dot(spark, sf_dir):
    return matrix.gram(matrix.from_edges(graphs.cust_supp(spark, sf_dir)))


@query("WITH e AS (SELECT DISTINCT user_id * 2 AS src, event_type FROM events) SELECT a.src AS i, b.src AS j, CAST(count(*) AS DOUBLE) AS v FROM e a JOIN e b ON a.event_type = b.event_type GROUP BY ALL")
def shared_events(spark, sf_dir):
    """AA' of users by event types: how many types two users share. Users have few different rows, and products are made for those."""
    return matrix.gram_of_rows(matrix.from_edges(graphs.user_events(spark, sf_dir)))


@query(f"WITH {PS} SELECT a.dst AS i, b.dst AS j, CAST(count(*) AS DOUBLE) AS v FROM ps a JOIN ps b ON a.src = b.src GROUP BY ALL")
def block_dot(spark, sf_dir):
    """A'A by products of dense blocks."""
    a = cut(matrix.from_edges(graphs.part_supp(spark, sf_dir)))
    return blocks.from_blocks(blocks.dot(blocks.to_blocks(matrix.transpose(a), BLOCK), blocks.to_blocks(a, BLOCK), BLOCK), BLOCK)


def stored(spark: SparkSession, a: DataFrame, name: str, inner: str) -> DataFrame:
    """A matrix written to a store by name, in buckets of one block index, and opened again."""
    path = new_folder(spark)
    blockstore.save(blocks.to_blocks(a, BLOCK), path, name, BLOCK, inner=inner, buckets=16)
    return blockstore.load(spark, path, name)


@query(f"WITH {PS} SELECT a.dst AS i, b.dst AS j, CAST(count(*) AS DOUBLE) AS v FROM ps a JOIN ps b ON a.src = b.src GROUP BY ALL")
def stored_product(spark, sf_dir):
    """A'A from the store, whose lines are packed bucket by bucket; A has a row for each part."""
    a = cut(matrix.from_edges(graphs.part_supp(spark, sf_dir)))
    turned, own = stored(spark, matrix.transpose(a), "turned", "bj"), stored(spark, a, "own", "bi")
    return blocks.from_blocks(blocks.dot_stored(turned, own, BLOCK), BLOCK)


@query(f"WITH {PS} SELECT src AS i, dst AS j, 1.0::DOUBLE AS v FROM ps WHERE src // {BLOCK} = 1")
def stored_block_row(spark, sf_dir):
    """The second block row of A, read from its bucket."""
    return blocks.from_blocks(blockstore.line(stored(spark, matrix.from_edges(graphs.part_supp(spark, sf_dir)), "own", "bi"), "bi", 1), BLOCK)


@query(f"WITH {CS}, d AS (SELECT dst AS i, dst AS j, -CAST(count(*) AS DOUBLE) AS v FROM cs GROUP BY dst), p AS (SELECT a.dst AS i, b.dst AS j, CAST(count(*) AS DOUBLE) AS v FROM cs a JOIN cs b ON a.src = b.src WHERE a.dst < b.dst GROUP BY ALL) SELECT i, j, v FROM d UNION ALL SELECT i, j, v FROM p UNION ALL SELECT j, i, v FROM p")
def block_add_signed(spark, sf_dir):
    """A'A less twice its diagonal, by products and sums of dense blocks."""
    a = cut(matrix.from_edges(graphs.cust_supp(spark, sf_dir)))
    twice = blocks.to_blocks(a.groupBy(F.col("j").alias("i")).agg(F.sum("v").alias("v")).select("i", F.col("i").alias("j"), "v"), BLOCK)
    return blocks.from_blocks(blocks.dot(blocks.to_blocks(matrix.transpose(a), BLOCK), blocks.to_blocks(a, BLOCK), BLOCK, plus=((-2, twice),)), BLOCK)


@query(f"WITH {TRADE} SELECT i, j, round(sum(v), 6) AS v FROM (SELECT i, j, v FROM tp WHERE party = 1 UNION ALL SELECT i, j, -v FROM tp WHERE party = 2) GROUP BY i, j")
def mat_add_signed(spark, sf_dir):
    tp = graphs.nation_trade(spark, sf_dir)
    return vals(matrix.add((1.0, tp.filter("party = 1").select("i", "j", "v")), (-1.0, tp.filter("party = 2").select("i", "j", "v"))))


@query(f"WITH {TRADE} SELECT i, j, round(v * 0.25, 6) AS v FROM t")
def mat_scale(spark, sf_dir):
    return vals(matrix.scale(trade(spark, sf_dir), 0.25))


@query(f"WITH {PS} SELECT dst AS i, src AS j, 1.0::DOUBLE AS v FROM ps")
def mat_transpose(spark, sf_dir):
    return matrix.transpose(matrix.from_edges(graphs.part_supp(spark, sf_dir)))


@query(f"WITH {SYM_CS} SELECT src AS i, dst AS j, round(1.0 / deg, 6) AS v FROM e JOIN d ON src = node")
def diag_left_inv(spark, sf_dir):
    sym = E.symmetrize(graphs.cust_supp(spark, sf_dir))
    return vals(matrix.diag_left(matrix.diagonal(stats.in_degree(sym)), matrix.from_edges(sym), inverse=True))


@query(f"WITH {SYM_CS} SELECT src AS i, dst AS j, deg AS v FROM e JOIN d ON dst = node")
def diag_right(spark, sf_dir):
    sym = E.symmetrize(graphs.cust_supp(spark, sf_dir))
    return matrix.diag_right(matrix.from_edges(sym), matrix.diagonal(stats.in_degree(sym)))


@query(f"WITH {TRADE} SELECT i, j, round(sum(v), 6) AS v FROM (SELECT i, j, v FROM t UNION ALL SELECT node, node, -deg FROM d) GROUP BY i, j")
def diag_add(spark, sf_dir):
    t = trade(spark, sf_dir)
    return vals(matrix.add((1.0, t), (-1.0, matrix.diagonal(trade_degree(t)))))


@query(f"WITH {TRADE} SELECT node AS i, node AS j, round(1.0 / deg, 6) AS v FROM d")
def diag_inverse(spark, sf_dir):
    d = matrix.diagonal(trade_degree(trade(spark, sf_dir)))
    return vals(matrix.diag_left(d, matrix.scale(matrix.diag_left(d, d, inverse=True), 1.0), inverse=True))


@query(f"WITH {TRADE} SELECT i, j, v FROM t")
def dense_cells(spark, sf_dir):
    """The cells of a small matrix made dense."""
    a = matrix.to_dense(trade(spark, sf_dir), 25)
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "i long, j long, v double")


@query(f"WITH {CS} SELECT count(*) AS cells, count(DISTINCT src) AS rows, count(DISTINCT dst) AS columns FROM cs")
def matrix_size(spark, sf_dir):
    return matrix.size(matrix.from_edges(graphs.cust_supp(spark, sf_dir)))


@query(f"WITH {TRADE} SELECT i, j, v, CAST(j // 6 AS BIGINT) AS slice FROM t WHERE j // 6 < 4")
def matrix_slices(spark, sf_dir):
    return matrix.slices(trade(spark, sf_dir), 25, 4, keep_rest=False)


@query("SELECT n, (SELECT min(k) FROM range(100, 100001) r(k) WHERE n % k = 0 AND k <= n) AS block_size FROM (SELECT CAST(p_size AS BIGINT) * 400 AS n FROM part GROUP BY p_size)")
def block_size_divisor(spark, sf_dir):
    return matrix.block_sizes(graphs.table(spark, sf_dir, "part").select((F.col("p_size").cast("long") * 400).alias("n")).distinct())


# Proximity.


@query(f"WITH {SYM_CS} SELECT src AS i, dst AS j, round(1.0 / deg, 6) AS v FROM e JOIN d ON src = node")
def row_normalized(spark, sf_dir):
    sym = E.symmetrize(graphs.cust_supp(spark, sf_dir))
    return vals(proximity.row_normalized(matrix.from_edges(sym), stats.in_degree(sym)))


def order1(sym: DataFrame) -> DataFrame:
    return proximity.proximity(matrix.from_edges(sym), stats.in_degree(sym), stats.volume(sym, "sum_weights"))


ORDER1 = f"WITH {SYM_CS}, m AS (SELECT src AS i, dst AS j, vol / (a.deg * b.deg) AS v FROM e JOIN d a ON src = a.node JOIN d b ON dst = b.node CROSS JOIN vol)"


@query(f"{ORDER1} SELECT i, j, round(ln(v), 6) AS v FROM m WHERE v > 1")
def prox_order1(spark, sf_dir):
    return vals(proximity.truncated_log(order1(E.symmetrize(graphs.cust_supp(spark, sf_dir)))))


@query(f"{ORDER1} SELECT i, j, round(v, 6) AS v FROM m")
def prox_order1_raw(spark, sf_dir):
    return vals(order1(E.symmetrize(graphs.cust_supp(spark, sf_dir))))


@query(f"{ORDER1} SELECT count(*) AS n_cells, count(*) FILTER (v > 1) AS n_kept, round(sum(CASE WHEN v > 1 THEN ln(v) ELSE 0 END), 4) AS total FROM m")
def prox_order1_trunc(spark, sf_dir):
    m = order1(E.symmetrize(graphs.cust_supp(spark, sf_dir)))
    kept = F.col("v") > 1
    return m.agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(kept).alias("n_kept"), F.round(F.sum(F.when(kept, F.ln("v")).otherwise(0.0)), 4).alias("total"))


@query(f"""WITH {SYM_PS}, x AS (SELECT src AS i, dst AS j, 1.0 / deg AS v FROM e JOIN d ON src = node),
s AS (SELECT i, j, v FROM x UNION ALL SELECT a.i, b.j, sum(a.v * b.v) FROM x a JOIN x b ON a.j = b.i GROUP BY a.i, b.j),
c AS (SELECT i, j, sum(v) AS v FROM s GROUP BY i, j), m AS (SELECT i, j, vol / 2 * v / deg AS v FROM c JOIN d ON j = node CROSS JOIN vol)
SELECT i, j, round(ln(v), 6) AS v FROM m WHERE v > 1 + 1e-9""")
def prox_window2(spark, sf_dir):
    sym = E.symmetrize(graphs.part_supp(spark, sf_dir))
    m = proximity.proximity(matrix.from_edges(sym), stats.in_degree(sym), stats.volume(sym, "sum_weights"), window=2)
    return vals(proximity.truncated_log(m.filter("v > 1 + 1e-9")))


@query(f"WITH {TRADE}, x2 AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM x a JOIN x b ON a.j = b.i GROUP BY ALL), x3 AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM x2 a JOIN x b ON a.j = b.i GROUP BY ALL), s AS (SELECT i, j, sum(v) AS v FROM (FROM x UNION ALL FROM x2 UNION ALL FROM x3) GROUP BY i, j) SELECT i, j, round(vol / 3 * v / deg, 6) AS v FROM s JOIN d ON j = node CROSS JOIN vol")
def prox_window3(spark, sf_dir):
    t = trade(spark, sf_dir)
    return vals(proximity.proximity(t, trade_degree(t), t.agg(F.sum("v").alias("vol")), window=3))


@query(f"WITH {PS} SELECT a.dst AS i, b.dst AS j, CAST(count(*) AS DOUBLE) AS v FROM ps a JOIN ps b ON a.src = b.src WHERE a.dst < b.dst GROUP BY ALL")
def two_hop(spark, sf_dir):
    return matrix.gram(matrix.from_edges(graphs.part_supp(spark, sf_dir)), mirrored=False).filter("i < j")


@query(f"WITH {TRADE} SELECT a.i, b.j, round(sum(a.v * b.v), 6) AS v FROM x a JOIN x b ON a.j = b.i GROUP BY a.i, b.j")
def party_square_identity(spark, sf_dir):
    tp = graphs.nation_trade(spark, sf_dir, 2)
    return vals(proximity.party_squares(trade_x_by_party(tp), 2))


@query(f"WITH {TRADE} SELECT a.i, b.j, round(sum(a.v * b.v), 6) AS v FROM x a JOIN x b ON a.j = b.i GROUP BY a.i, b.j")
def party_square_identity_3(spark, sf_dir):
    return vals(proximity.party_squares(trade_x_by_party(graphs.nation_trade(spark, sf_dir, 3)), 3))


def trade_x_by_party(tp: DataFrame) -> DataFrame:
    deg = tp.groupBy(F.col("j").alias("i")).agg(F.sum("v").alias("d"))
    return tp.join(deg, "i").select("i", "j", "party", (F.col("v") / F.col("d")).alias("v"))


@query(f"WITH {TRADE} SELECT i, j, party, round(v, 6) AS v FROM xp")
def row_normalized_by_party(spark, sf_dir):
    return vals(trade_x_by_party(graphs.nation_trade(spark, sf_dir)))


# Masks and protocol; the SQL has the unmasked answers.


@query(f"WITH {TRADE} SELECT i, j, round(v, 6) AS v FROM t")
def secure_sum(spark, sf_dir):
    return vals(masks.secure_sum(graphs.nation_trade(spark, sf_dir), 2, seed=5))


@query(f"WITH {TRADE} SELECT i, j, round(v, 4) AS v FROM t")
def masked_roundtrip(spark, sf_dir):
    t = blocks.to_blocks(trade(spark, sf_dir), 10)
    p, q = masks.orthogonal_blocks(spark, 25, 10, 21), masks.orthogonal_blocks(spark, 25, 10, 22)
    # cells that are zero but for the last digits aren't part of a sparse matrix
    return vals(blocks.from_blocks(masks.demask(p, masks.mask(p, t, q, 10), q, 10), 10, 1e-6)).withColumn("v", rounded(F.col("v"), 4))


@query("SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS j, 1.0::DOUBLE AS v FROM range((SELECT count(*) FROM supplier)) r(i)")
def mask_orthogonality(spark, sf_dir):
    """Q Q' of a mask as wide as there are suppliers: the identity."""
    q = masks.orthogonal_blocks(spark, graphs.table(spark, sf_dir, "supplier").count(), 64, 21)
    return vals(blocks.from_blocks(blocks.dot(q, blocks.transpose(q, 64), 64), 64, 1e-9))


@query(f"WITH {TRADE} SELECT a.i, b.j, round(sum(a.v * b.v), 6) AS v FROM x a JOIN x b ON a.j = b.i GROUP BY a.i, b.j")
def protocol_square(spark, sf_dir):
    x = trade_x_by_party(graphs.nation_trade(spark, sf_dir))
    own = [blocks.to_blocks(x.filter(F.col("party") == p).select("i", "j", "v"), 10) for p in (1, 2)]
    return vals(blocks.from_blocks(masks.protocol_square(spark, own[0], own[1], 25, size=10), 10, 1e-9))


def masked(spark: SparkSession, sf_dir: str, window: int) -> DataFrame:
    tp = graphs.nation_trade(spark, sf_dir)
    x = trade_x_by_party(tp)
    own = [x.filter(F.col("party") == p).select("i", "j", "v") for p in (1, 2)]
    vol = float(tp.agg(F.sum("v")).first()[0] or 0.0)
    return vals(masks.masked_proximity(spark, own, trade_degree(tp), vol, 25, window=window, size=10))


def masked_parts(spark: SparkSession, sf_dir: str, window: int) -> DataFrame:
    """The masked proximity of parts and suppliers, whose edges two parties hold."""
    sym = E.symmetrize(E.split_parties(graphs.part_supp(spark, sf_dir), 2)).withColumn("w", F.lit(1.0))
    degree = stats.in_degree(sym)
    x = sym.join(degree, F.col("src") == F.col("node")).select(F.col("src").alias("i"), F.col("dst").alias("j"), "party", (1 / F.col("deg")).alias("v"))
    n, vol = sym.agg(F.coalesce(F.max("src"), F.lit(0)) + 1, F.coalesce(F.sum("w"), F.lit(0.0))).first()
    own = [x.filter(F.col("party") == p).select("i", "j", "v") for p in (1, 2)]
    return masks.masked_proximity(spark, own, degree, vol, n, window=window, size=BLOCK, least=1e-5)


@query(f"WITH {SYM_PS} SELECT src AS i, dst AS j, round(vol / (a.deg * b.deg), 5) AS v FROM e JOIN d a ON src = a.node JOIN d b ON dst = b.node CROSS JOIN vol")
def masked_order1_parts(spark, sf_dir):
    return masked_parts(spark, sf_dir, 1).withColumn("v", rounded(F.col("v"), 5))


@query(f"""WITH {SYM_PS}, x AS (SELECT src AS i, dst AS j, 1.0 / deg AS v FROM e JOIN d ON src = node),
s AS (SELECT i, j, v FROM x UNION ALL SELECT a.i, b.j, sum(a.v * b.v) FROM x a JOIN x b ON a.j = b.i GROUP BY a.i, b.j),
c AS (SELECT i, j, sum(v) AS v FROM s GROUP BY i, j), m AS (SELECT i, j, vol / 2 * v / deg AS v FROM c JOIN d ON j = node CROSS JOIN vol)
SELECT CAST(i // {BLOCK} AS BIGINT) AS bi, CAST(j // {BLOCK} AS BIGINT) AS bj, count(*) AS n, round(sum(ln(v)), 1) AS total FROM m WHERE v > 1 + 1e-5 GROUP BY ALL""")
def masked_window2_parts(spark, sf_dir):
    """Its truncated logarithm, added up by block: masks leave rounding in each of millions of cells."""
    m = matrix.with_blocks(proximity.truncated_log(masked_parts(spark, sf_dir, 2).filter("v > 1 + 1e-5")), BLOCK)
    return m.groupBy("bi", "bj").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("v"), 1).alias("total"))


@query(f"WITH {TRADE} SELECT a.i, b.j, round(sum(a.v * b.v), 6) AS v FROM xp a JOIN xp b ON a.j = b.i AND a.party = 1 AND b.party = 1 GROUP BY a.i, b.j")
def masked_own_square(spark, sf_dir):
    """P X^2 Q of one party's X, demasked."""
    x = blocks.to_blocks(trade_x_by_party(graphs.nation_trade(spark, sf_dir)).filter("party = 1").select("i", "j", "v"), 10)
    p, q = masks.orthogonal_blocks(spark, 25, 10, 21), masks.orthogonal_blocks(spark, 25, 10, 22)
    return vals(blocks.from_blocks(masks.demask(p, masks.masked_square(p, x, q, 10), q, 10), 10, 1e-9))


@query(f"WITH {TRADE} SELECT x.i, x.j, round(vol * x.v / deg, 6) AS v FROM x JOIN d ON x.j = node CROSS JOIN vol")
def masked_order1(spark, sf_dir):
    return masked(spark, sf_dir, 1)


@query(f"WITH {TRADE}, s AS (SELECT i, j, v FROM x UNION ALL SELECT a.i, b.j, sum(a.v * b.v) FROM x a JOIN x b ON a.j = b.i GROUP BY a.i, b.j), c AS (SELECT i, j, sum(v) AS v FROM s GROUP BY i, j) SELECT i, j, round(vol / 2 * c.v / deg, 6) AS v FROM c JOIN d ON j = node CROSS JOIN vol")
def masked_window2(spark, sf_dir):
    return masked(spark, sf_dir, 2)


@query(SQL["masked_window2"])
def party_window2(spark, sf_dir):
    """The same from what each pair of three parties can compute."""
    tp = graphs.nation_trade(spark, sf_dir, 3)
    return vals(proximity.party_proximity(trade_x_by_party(tp), trade_degree(tp), tp.agg(F.sum("v").alias("vol")), 3))


@query(f"WITH {TRADE} SELECT a.i, b.j, round(sum(a.v * b.v) / (max(l.deg) * max(r.deg)), 6) AS v FROM tp a JOIN tp b ON a.j = b.i AND a.party = 1 AND b.party = 1 JOIN d l ON l.node = a.i JOIN d r ON r.node = b.j GROUP BY a.i, b.j")
def own_square(spark, sf_dir):
    """One party's D^-1 A_p^2 D^-1 with the degrees of the whole graph."""
    tp = graphs.nation_trade(spark, sf_dir)
    own, d = tp.filter("party = 1").select("i", "j", "v"), matrix.diagonal(trade_degree(tp))
    return vals(matrix.diag_right(matrix.diag_left(d, matrix.dot(own, own), inverse=True), d, inverse=True))


# Path sampling.

HELD = f"{PS}, {SPLIT}, ranked AS (SELECT src, dst, party, row_number() OVER (PARTITION BY party ORDER BY src, dst) - 1 AS e, count(*) OVER (PARTITION BY party) AS vol FROM split), counted AS (SELECT *, vol * {PER_EDGE} // ({WORKERS} * {PARTIES}) AS draws FROM ranked)"
SAMPLED = HELD + f", sampled AS (SELECT src AS i, dst AS j, party, {WORKERS} * (draws // vol + CASE WHEN e < draws % vol THEN 1 ELSE 0 END) AS n FROM counted)"


def held_part_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.party_edges(split_part_supp(spark, sf_dir))


@query(f"WITH {SAMPLED} SELECT i, j, party, round(n / {PER_EDGE}.0, 6) AS v FROM sampled")
def sample_counts_t1(spark, sf_dir):
    counts = walks.sample_counts(held_part_supp(spark, sf_dir), per_edge=PER_EDGE, workers=WORKERS, parties=PARTIES)
    return vals(walks.expected_order1(counts, PER_EDGE))


@query(f"""WITH {TRADE}, o AS (SELECT i, sum(v) AS s FROM t GROUP BY i), p AS (SELECT t.i, t.j, t.v / s AS v FROM t JOIN o ON t.i = o.i),
ap AS (SELECT t.i, p.j, sum(t.v * p.v) AS v FROM t JOIN p ON t.j = p.i GROUP BY ALL), pa AS (SELECT p.j AS i, t.j, sum(p.v * t.v) AS v FROM p JOIN t ON p.i = t.i GROUP BY ALL),
s AS (SELECT i, j, v / 4 AS v FROM t UNION ALL SELECT i, j, v / 8 FROM ap UNION ALL SELECT i, j, v / 8 FROM pa) SELECT i, j, round(sum(v), 6) AS v FROM s GROUP BY i, j""")
def sparsifier_expected_r2(spark, sf_dir):
    return vals(walks.expected_sparsifier(trade(spark, sf_dir), window=2, parties=2))


@query(f"WITH {SAMPLED}, a AS (SELECT i, j, sum(n) / {PER_EDGE}.0 AS v FROM sampled GROUP BY i, j), c AS (SELECT j AS i, j, sum(v) AS v FROM a GROUP BY j UNION ALL SELECT i, j, -v FROM a) SELECT i, j, round(sum(v), 6) AS v FROM c GROUP BY i, j")
def laplacian(spark, sf_dir):
    counts = walks.sample_counts(held_part_supp(spark, sf_dir), per_edge=PER_EDGE, workers=WORKERS, parties=PARTIES)
    a = walks.expected_order1(counts, PER_EDGE).groupBy("i", "j").agg(F.sum("v").alias("v"))
    return vals(walks.laplacian(a))


PARTY_LOG = f"""WITH {TRADE}, dp AS (SELECT party, j AS i, j, sum(v) AS v FROM tp GROUP BY party, j), ap AS (SELECT party, i, j, v / 2 AS v FROM tp),
cells AS (SELECT party, i, j, v FROM dp UNION ALL SELECT party, j, j, -sum(v) FROM ap GROUP BY party, j UNION ALL SELECT party, i, j, v FROM ap),
s AS (SELECT party, i, j, sum(v) AS v FROM cells GROUP BY party, i, j), m AS (SELECT party, s.i, s.j, vol * v / (a.deg * b.deg) AS v FROM s JOIN d a ON s.i = a.node JOIN d b ON s.j = b.node CROSS JOIN vol)"""


def trade_sampled(spark: SparkSession, sf_dir: str, log_mode: str) -> DataFrame:
    tp = graphs.nation_trade(spark, sf_dir)
    by_party = tp.groupBy(F.col("j").alias("node"), "party").agg(F.sum("v").alias("deg"))
    vol = tp.agg(F.sum("v")).first()[0]
    half = tp.select("i", "j", "party", (F.col("v") / 2).alias("v"))
    return vals(walks.sampled_proximity(half, by_party, stats.global_degree(by_party), float(vol or 0.0), log_mode=log_mode))


@query(f"{PARTY_LOG} SELECT i, j, round(sum(ln(v)), 6) AS v FROM m WHERE v > 1 GROUP BY i, j")
def party_log_sum(spark, sf_dir):
    return trade_sampled(spark, sf_dir, "per_party")


@query(f"{PARTY_LOG}, g AS (SELECT i, j, sum(v) AS v FROM m GROUP BY i, j) SELECT i, j, round(ln(v), 6) AS v FROM g WHERE v > 1")
def party_log_global(spark, sf_dir):
    return trade_sampled(spark, sf_dir, "global")


@query(f"{PARTY_LOG} SELECT i, j, round(sum(v), 6) AS v FROM m GROUP BY i, j HAVING sum(v) != 0")
def party_no_log(spark, sf_dir):
    return trade_sampled(spark, sf_dir, "none")


@query(f"{PARTY_LOG} SELECT i, j, round(sum(ln(v)), 6) AS v FROM m WHERE v > 1 GROUP BY i, j")
def party_log_masked(spark, sf_dir):
    """The sum of the logarithms under a mask that all parties put on the right, with the mask undone."""
    o = masks.orthogonal_blocks(spark, 25, 10, 23)
    sent = masks.masked_sampled(trade_sampled(spark, sf_dir, "per_party"), o, 10)
    return vals(blocks.from_blocks(blocks.dot(sent, blocks.transpose(o, 10), 10), 10, 1e-8))


@query(f"""WITH {CANON}, split AS (SELECT src, dst, CAST(ntile({PARTIES}) OVER (ORDER BY {KEY}, src, dst) AS INTEGER) AS party FROM canon WHERE src <> dst),
ways AS (SELECT src, dst, party FROM split UNION ALL SELECT dst, src, party FROM split),
counted AS (SELECT party, row_number() OVER (PARTITION BY party ORDER BY src, dst) - 1 AS e, count(*) OVER (PARTITION BY party) AS vol FROM ways)
SELECT party, round(sum(4 * (vol * 24 // (4 * {PARTIES}) // vol + CASE WHEN e < vol * 24 // (4 * {PARTIES}) % vol THEN 1 ELSE 0 END)) / 24.0, 4) AS mass, 0::BIGINT AS unreachable FROM counted GROUP BY party""")
def path_samples(spark, sf_dir):
    """Of each party's sampled sparsifier of window 2: its mass, which is the number of samples over 24 where walks have no dead ends, and the cells that no walk of the party reaches."""
    lines = raw_lines(spark, sf_dir).filter("src != dst")
    held = cut(E.party_edges(E.split_undirected(lines, PARTIES)))
    sampled = walks.path_samples(held, window=2, per_edge=24, workers=4, parties=PARTIES, origin=True, summed=False)
    mass, lost = checked_samples(sampled, held.select("party", "src", "dst"))
    return mass.join(lost.groupBy("party").agg(F.count(F.lit(1)).alias("lost")), "party", "left").select("party", rounded(F.col("mass"), 4).alias("mass"), F.coalesce("lost", F.lit(0)).alias("unreachable"))


def checked_samples(sampled: DataFrame, step: DataFrame) -> tuple[DataFrame, DataFrame]:
    """party, mass of samples (i, j, v, party, origin) of two edges at most; party, i, j of their cells that no two edges of step (party, src, dst) join.

    A walk tells by its origin which steps it made. Samples are added up by step,
    which are hardly more than edges, so samples themselves are never moved. If every step
    is an edge, each cell has a path; else the cells of walks with another step are tried by all neighbours.
    """
    k = F.when(F.col("origin.j") == F.col("j"), F.col("origin.i")).otherwise(F.col("origin.j"))
    step_of = lambda a, b, v: F.struct(a.alias("a"), b.alias("b"), v.alias("v"))
    stayed = (F.col("origin.i") == F.col("i")) & (F.col("origin.j") == F.col("j"))
    made = F.when(stayed, F.array(step_of(F.col("i"), F.col("j"), F.col("v")))).otherwise(F.array(step_of(F.col("i"), k, F.col("v")), step_of(k, F.col("j"), F.lit(0.0))))
    used = cut(sampled.select("party", F.inline(made)).groupBy("party", "a", "b").agg(F.sum("v").alias("v")))
    wrong = cut(used.select("party", "a", "b").join(step.select("party", F.col("src").alias("a"), F.col("dst").alias("b")), ["party", "a", "b"], "left_anti"))
    mass = used.groupBy("party").agg(F.sum("v").alias("mass"))
    if wrong.isEmpty():
        return mass, wrong.select("party", F.col("a").alias("i"), F.col("b").alias("j"))
    walks_of = sampled.select("party", "i", "j", k.alias("k"), F.inline(made)).join(wrong, ["party", "a", "b"], "left_semi")
    cells = walks_of.groupBy("party", "i", "j").agg(F.min("k").alias("k"))
    far = cells.join(step.select("party", F.col("src").alias("i"), F.col("dst").alias("j")), ["party", "i", "j"], "left_anti")
    return mass, unreachable(far, step)


def unreachable(far: DataFrame, step: DataFrame) -> DataFrame:
    """party, i, j of the cells of far (party, i, j, k) that no two edges of step (party, src, dst) join.

    The node k where a walk says that it passed is tried first, by one look at
    each of two edges; only cells that this leaves are tried by all neighbours.
    """
    before = step.select("party", F.col("src").alias("i"), F.col("dst").alias("k"))
    after = step.select("party", F.col("src").alias("k"), F.col("dst").alias("j"))
    tried = far.join(before.withColumn("a", F.lit(True)), ["party", "i", "k"], "left").join(after.withColumn("b", F.lit(True)), ["party", "k", "j"], "left")
    far = cut(tried.filter("a IS NULL OR b IS NULL").select("party", "i", "j"))
    by_two = far.join(before, ["party", "i"]).join(after, ["party", "k", "j"], "left_semi").select("party", "i", "j").distinct()
    return far.join(by_two, ["party", "i", "j"], "left_anti")


def uniform_sql(seed: int, keys: str) -> str:
    """SQL of md5_uniform(seed, *keys)."""
    return f"(('0x' || substr(md5('{seed}:' || {keys}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


#: The stretches of the edges of `ways` (party, src, dst, w), scaled to their sources' numbers of edges.
GUIDE = """g0 AS (SELECT party, src, dst, w::DOUBLE AS w, sum(w::DOUBLE) OVER (PARTITION BY party, src ORDER BY dst) AS high, sum(w::DOUBLE) OVER (PARTITION BY party, src) AS total, count(*) OVER (PARTITION BY party, src) AS deg FROM ways),
guide AS (SELECT party, src, dst, deg, (high - w) * deg / total AS low, CASE WHEN high = total THEN deg ELSE high * deg / total END AS high FROM g0)"""
#: Walkers of `asked` (party, at, u, ...) fall into one stretch of their node.
INSIDE = "a.party = g.party AND a.at = g.src AND least(a.u * g.deg, g.deg * (1 - 1 / 4503599627370496.0::DOUBLE)) >= g.low AND least(a.u * g.deg, g.deg * (1 - 1 / 4503599627370496.0::DOUBLE)) < g.high"


@query(f"""WITH {TRADE}, ways AS (SELECT party, i AS src, j AS dst, v * (1 + j % 5) AS w FROM tp), {GUIDE},
asked AS (SELECT CAST(o_orderkey % 2 + 1 AS INTEGER) AS party, CAST(c_nationkey AS BIGINT) AS at, {uniform_sql(7, "(o_orderkey % 2 + 1) || ':' || (l_orderkey * 8 + l_linenumber)")} AS u
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
ends AS (SELECT a.party, a.at AS node, g.dst AS target, count(*) AS walkers FROM asked a JOIN guide g ON {INSIDE} GROUP BY ALL)
SELECT party, node, target, walkers, true AS near FROM ends""")
def weighted_steps(spark, sf_dir):
    """Where the walkers, one for each line of an order, get from its customer's nation by one step weighted by trade; near: the share of an end is within six deviations of its weight's share."""
    edges = graphs.nation_trade(spark, sf_dir).select("party", F.col("i").alias("src"), F.col("j").alias("dst"), (F.col("v") * (1 + F.col("j") % 5)).alias("w"))
    guide, places = walks.walk_index(edges)
    lines = graphs.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    orders = graphs.table(spark, sf_dir, "orders").join(graphs.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").cast("long").alias("node"))
    start = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_orderkey") % 2 + 1).cast("int").alias("party"), "node", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("draw"))
    rows = start.join(places, ["party", "node"]).withColumns({"at": F.col("node"), "hits": F.lit(0)})
    ends = walks.step(rows, guide, "at", "deg", 7, md5_uniform).groupBy("party", "node", F.col("at").alias("target")).agg(F.count(F.lit(1)).alias("walkers"))
    told = cut(ends)
    share = edges.join(edges.groupBy("party", "src").agg(F.sum("w").alias("total")), ["party", "src"]).select("party", F.col("src").alias("node"), F.col("dst").alias("target"), (F.col("w") / F.col("total")).alias("p"))
    all_of = told.groupBy("party", "node").agg(F.sum("walkers").alias("n"))
    far = F.abs(F.col("walkers") / F.col("n") - F.col("p")) - 1 / F.col("n")
    return told.join(share, ["party", "node", "target"]).join(all_of, ["party", "node"]).select("party", "node", "target", "walkers", (far <= 6 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))).alias("near"))


#: Edges between parts and suppliers, weighted by lines and unevenly by their numbers, in both directions, held by one party each.
UNEVEN = CANON.replace("canon AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM raw)", f"""canon AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, count(*) * (1 + (src + dst) % 5) AS w FROM raw WHERE src <> dst GROUP BY least(src, dst), greatest(src, dst), src + dst),
split AS (SELECT src, dst, w, CAST(ntile({PARTIES}) OVER (ORDER BY {KEY}, src, dst) AS INTEGER) AS party FROM canon), ways AS (SELECT src, dst, w, party FROM split UNION ALL SELECT dst, src, w, party FROM split)""")


def samples_sql(per_edge: int, workers: int, parties: int, seed: int = 1) -> str:
    """`cells` (party, i, j, v): the sparsifier of window 2 over `ways`, every draw repeated; without dead ends."""
    draws = f"(vol * {per_edge} // ({workers} * {parties}))"
    return f"""{GUIDE}, counted AS (SELECT party, src, dst, row_number() OVER (PARTITION BY party ORDER BY src, dst) - 1 AS e, count(*) OVER (PARTITION BY party) AS vol FROM ways),
begun AS (SELECT party, src, dst, e, {workers} * ({draws} // vol + CASE WHEN e < {draws} % vol THEN 1 ELSE 0 END) AS n FROM counted),
drawn AS (SELECT party, src, dst, (e * {per_edge + workers + 1} + unnest(range(1, n + 1))) * 3 + 2 AS draw FROM begun),
first AS (SELECT party, src, dst, draw, {uniform_sql(seed, "party || ':' || draw")} >= 0.5 AS back FROM drawn),
asked AS (SELECT party, src, dst, back, CASE WHEN back THEN src ELSE dst END AS at, {uniform_sql(seed + 2001, "party || ':' || draw")} AS u FROM first),
moved AS (SELECT a.party, CASE WHEN a.back THEN g.dst ELSE a.src END AS i, CASE WHEN a.back THEN a.dst ELSE g.dst END AS j, 1 / {2 * per_edge}.0::DOUBLE AS v FROM asked a JOIN guide g ON {INSIDE}),
cells AS (SELECT party, i, j, sum(v) AS v FROM (SELECT * FROM moved UNION ALL SELECT party, src, dst, n / {2 * per_edge}.0::DOUBLE FROM begun WHERE n > 0) GROUP BY ALL)"""


@query(f"WITH {UNEVEN}, {samples_sql(12, 4, PARTIES)} SELECT party, i, j, round(v, 6) AS v FROM cells")
def weighted_path_samples(spark, sf_dir):
    """Every cell of each party's sampled sparsifier of window 2 with weighted steps."""
    lines = raw_lines(spark, sf_dir).filter("src != dst")
    weights = lines.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    weights = weights.select("src", "dst", (F.col("n") * (1 + (F.col("src") + F.col("dst")) % 5)).cast("double").alias("w"))
    ways = E.symmetrize(E.split_parties(weights, PARTIES))
    return vals(walks.path_samples(ways, window=2, per_edge=12, workers=4, parties=PARTIES, weighted=True, uniform=md5_uniform))


# Panels and factorization.


def arithmetic_panel(nodes: DataFrame, d: int) -> DataFrame:
    return nodes.select(F.col("node").alias("i"), F.array(*[((F.col("node") * 31 + k * 17) % 101 / F.lit(101.0)).cast("double") for k in range(d)]).alias("y"))


@query(f"WITH {SYM_CS}, c AS (SELECT src AS i, k, sum((dst * 31 + k * 17) % 101 / 101.0::DOUBLE) AS v FROM e, range(4) r(k) GROUP BY ALL) SELECT i, CAST(k AS BIGINT) AS j, round(v, 6) AS v FROM c")
def panel_dot(spark, sf_dir):
    sym = E.symmetrize(graphs.cust_supp(spark, sf_dir))
    return vals(evaluate.panel_cells(factor.panel_dot(matrix.from_edges(sym), arithmetic_panel(embeddings.nodes_of(sym), 4), 4)))


@query(f"WITH {TRADE}, c AS (SELECT i, k, sum(v * ((j * 31 + k * 17) % 101 / 101.0::DOUBLE)) AS v FROM tp, range(4) r(k) GROUP BY ALL) SELECT i, CAST(k AS BIGINT) AS j, round(v, 6) AS v FROM c")
def panel_sum(spark, sf_dir):
    tp = graphs.nation_trade(spark, sf_dir)
    nodes = tp.select(F.col("j").alias("node")).distinct()
    return vals(evaluate.panel_cells(factor.panel_sum(factor.panel_dot(tp, arithmetic_panel(nodes, 4), 4, ("party",)), 4)))


@query("WITH c AS (SELECT vec_id AS i, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings), n AS (SELECT i, sqrt(sum(v * v)) AS n FROM c GROUP BY i) SELECT c.i, CAST(j AS BIGINT) AS j, round(CASE WHEN n > 0 THEN v / n ELSE 0 END, 5) AS v FROM c JOIN n ON c.i = n.i")
def row_l2_normalize(spark, sf_dir):
    panel = graphs.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("y"))
    return evaluate.panel_cells(factor.l2_normalize(panel)).withColumn("v", rounded(F.col("v"), 5))


@query("WITH k AS (SELECT DISTINCT CAST(range AS INTEGER) AS k FROM range(len((SELECT any_value(embedding) FROM embeddings)))) SELECT CAST(k AS BIGINT) AS i, CAST(k AS BIGINT) AS j, 1.0::DOUBLE AS v FROM k")
def panel_orthonormal(spark, sf_dir):
    """The Gram matrix of the orthonormal basis of the vectors' panel: the identity."""
    panel = graphs.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("y"))
    d = panel.agg(F.max(F.size("y"))).first()[0] or 0
    q, width = factor.orthonormal(panel, d)
    g = factor.gram(q, width)
    return spark.createDataFrame([(i, j, round(float(g[i, j]), 6) + 0.0) for i in range(width) for j in range(width) if abs(g[i, j]) > 1e-9], "i long, j long, v double")


STAR = """cn AS (SELECT c_custkey * 2 AS src, CAST(c_nationkey AS BIGINT) * 2 + 1 AS dst FROM customer), e AS (SELECT src, dst FROM cn UNION ALL SELECT dst, src FROM cn),
d AS (SELECT dst AS node, count(*)::DOUBLE AS deg FROM e GROUP BY dst), vol AS (SELECT count(*)::DOUBLE AS vol FROM e)"""
#: More directions than the matrices of customers and nations, and of nations, have.
FULL = 50


@query("SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, c_nationkey) - 1 AS BIGINT) AS k, round(sqrt(count(*)), 6) AS value FROM customer GROUP BY c_nationkey")
def singular_values(spark, sf_dir):
    """Those of customers by nations: the roots of the nations' numbers of customers."""
    a = matrix.from_edges(graphs.customer_nations(spark, sf_dir))
    _, s = factor.randomized_svd(a, FULL // 2, rounds=2)
    found = sorted((float(x) for x in s if x > 1e-6), reverse=True)
    return vals(spark.createDataFrame(list(enumerate(found)), "k long, value double"), "value")


@query("SELECT CAST(k AS BIGINT) AS k, round(value, 6) AS value, true AS bounded FROM (SELECT row_number() OVER (ORDER BY count(*) DESC, c_nationkey) - 1 AS k, sqrt(count(*)) AS value FROM customer GROUP BY c_nationkey) WHERE k < 8")
def singular_values_bounded(spark, sf_dir):
    """The eight largest of the nations' values, which decay slowly: from panels of twelve, until the bounds are met."""
    a = matrix.from_edges(graphs.customer_nations(spark, sf_dir))
    _, s, bounds = factor.svd_to_tolerance(a, 8, tolerance=1e-8, oversample=4)
    return vals(spark.createDataFrame([(k, float(x), bool(b <= 1e-8 * s[0])) for k, (x, b) in enumerate(zip(s, bounds, strict=True))], "k long, value double, bounded boolean"), "value")


@query(f"WITH {STAR}, n AS (SELECT node, deg, vol FROM d CROSS JOIN vol WHERE node % 2 = 1) SELECT src AS node, round(sqrt(ln(vol / deg) / sqrt(deg)), 4) AS length FROM cn JOIN n ON dst = node UNION ALL SELECT node, round(sqrt(ln(vol / deg) * sqrt(deg)), 4) FROM n")
def randomized_embedding(spark, sf_dir):
    """The lengths of the vectors of customers and nations from the order-1 proximity, which a star has in closed form."""
    sym = E.symmetrize(graphs.customer_nations(spark, sf_dir)).withColumn("w", F.lit(1.0))
    return lengths(embeddings.exact_embedding(sym, FULL, rounds=2))


def lengths(emb: DataFrame) -> DataFrame:
    return emb.select("node", rounded(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)), 4).alias("length"))


def energy(emb: DataFrame, d: int) -> DataFrame:
    """One row, energy: the sum of squared singular values, from vectors that are singular vectors times their roots. With all directions it is the matrix's sum of squares."""
    square = lambda k: (F.col("vec")[k] * F.col("vec")[k]).cast("decimal(38,18)")  # noqa: E731  whose sum doesn't round; millions of equal doubles all round the same way
    squares = emb.agg(*[F.sum(square(k)).cast("double").alias(f"s{k}") for k in range(d)])
    return squares.select(rounded(sum((F.col(f"s{k}") * F.col(f"s{k}") for k in range(d)), F.lit(0.0)), 3).alias("energy"))


@query(f"""WITH {STAR}, m AS (SELECT ln(vol / (a.deg * b.deg)) AS v FROM e JOIN d a ON src = a.node JOIN d b ON dst = b.node CROSS JOIN vol WHERE vol > a.deg * b.deg)
SELECT round(sum(v * v), 3) AS energy FROM m""")
def embedding_energy(spark, sf_dir):
    return energy(embeddings.exact_embedding(E.symmetrize(graphs.customer_nations(spark, sf_dir)).withColumn("w", F.lit(1.0)), FULL, rounds=2), FULL)


@query(f"""WITH {STAR}, split AS (SELECT src, dst, CAST(ntile(2) OVER (ORDER BY {KEY}, src, dst) AS INTEGER) AS party FROM cn), held AS (SELECT src, dst, party FROM split UNION ALL SELECT dst, src, party FROM split),
counted AS (SELECT *, row_number() OVER (PARTITION BY party ORDER BY src, dst) - 1 AS e, count(*) OVER (PARTITION BY party) AS n FROM held),
a AS (SELECT src AS i, dst AS j, party, (n * 64 // 2 // n + CASE WHEN e < n * 64 // 2 % n THEN 1 ELSE 0 END) / 64.0::DOUBLE AS v FROM counted),
cells AS (SELECT party, dst AS i, dst AS j, count(*)::DOUBLE AS v FROM held GROUP BY party, dst UNION ALL SELECT party, j, j, -sum(v) FROM a GROUP BY party, j UNION ALL SELECT party, i, j, v FROM a),
s AS (SELECT party, i, j, sum(v) AS v FROM cells GROUP BY party, i, j), m AS (SELECT s.i, s.j, vol * v / (p.deg * q.deg) AS v FROM s JOIN d p ON s.i = p.node JOIN d q ON s.j = q.node CROSS JOIN vol),
l AS (SELECT i, j, sum(ln(v)) AS v FROM m WHERE v > 1 AND i <> j GROUP BY i, j) SELECT round(sum(v * v), 3) AS energy FROM l""")
def sampled_embedding(spark, sf_dir):
    """The energy of the sampled embedding of customers and nations; cells of a node with itself are left out, since a star's customers have a full diagonal."""
    split = E.symmetrize(E.split_parties(graphs.customer_nations(spark, sf_dir), 2))
    return energy(embeddings.sampled_embedding(split, FULL, parties=2, window=1, per_edge=64, workers=1, rounds=2, normalize=False, diagonal=False), FULL)


@query(f"""WITH {TRADE}, ways AS (SELECT party, i AS src, j AS dst, v * (1 + j % 5) AS w FROM tp), {samples_sql(64, 1, 2, seed=3)},
deg AS (SELECT dst AS node, count(*)::DOUBLE AS deg FROM ways GROUP BY dst), n AS (SELECT count(*)::DOUBLE AS n FROM ways),
parts AS (SELECT party, dst AS i, dst AS j, count(*)::DOUBLE AS v FROM ways GROUP BY party, dst UNION ALL SELECT party, j, j, -sum(v) FROM cells GROUP BY party, j UNION ALL SELECT party, i, j, v FROM cells),
s2 AS (SELECT party, i, j, sum(v) AS v FROM parts GROUP BY party, i, j),
m AS (SELECT s2.i, s2.j, n / 0.1 * s2.v / (p.deg * q.deg) AS v FROM s2 JOIN deg p ON s2.i = p.node JOIN deg q ON s2.j = q.node CROSS JOIN n),
l AS (SELECT i, j, sum(ln(v)) AS v FROM m WHERE v > 1 AND i <> j GROUP BY i, j) SELECT round(coalesce(sum(v * v), 0), 3) AS energy FROM l""")
def sampled_embedding_window2(spark, sf_dir):
    """The energy of the embedding of nations from two parties' walks of window 2, whose steps trade weights."""
    split = graphs.nation_trade(spark, sf_dir).select(F.col("i").alias("src"), F.col("j").alias("dst"), "party", (F.col("v") * (1 + F.col("j") % 5)).alias("w"))
    emb = embeddings.sampled_embedding(split, FULL // 2, parties=2, window=2, per_edge=64, workers=1, negative=0.1, rounds=3, normalize=False, diagonal=False, weighted=True, uniform=md5_uniform)
    return energy(emb, FULL // 2)


@query(f"""WITH {TRADE}, s AS (SELECT i, j, v FROM x UNION ALL SELECT a.i, b.j, sum(a.v * b.v) FROM x a JOIN x b ON a.j = b.i GROUP BY a.i, b.j), c AS (SELECT i, j, sum(v) AS v FROM s GROUP BY i, j),
m AS (SELECT vol / 2 * c.v / deg AS v FROM c JOIN d ON j = node CROSS JOIN vol) SELECT round(coalesce(sum(ln(v) * ln(v)), 0), 3) AS energy FROM m WHERE v > 1""")
def window2_embedding(spark, sf_dir):
    edges = trade(spark, sf_dir).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("v").alias("w"))
    return energy(embeddings.exact_embedding(edges, FULL // 2, window=2, rounds=3), FULL // 2)


@query(f"WITH {SYM_CS} SELECT CAST(k AS BIGINT) AS k, (SELECT count(*) FROM d) AS nodes, 0.0::DOUBLE AS slant FROM range(16) r(k)")
def embedding_axes(spark, sf_dir):
    """For each direction of the embedding of customers and suppliers: the nodes, and its largest cosine with another direction, which is 0."""
    emb = cut(embeddings.exact_embedding(E.symmetrize(graphs.cust_supp(spark, sf_dir)).withColumn("w", F.lit(1.0)), 16, rounds=2).select(F.col("node").alias("i"), F.col("vec").alias("y")))
    g = factor.gram(emb, 16)
    size = np.sqrt(np.diag(g))
    slant = np.abs(g / np.outer(size, size) - np.eye(16)).max(0)
    return spark.createDataFrame([(k, emb.count(), round(float(slant[k]), 5) + 0.0) for k in range(16)], "k long, nodes long, slant double")


@query(f"WITH {PS}, {SPLIT}, n AS (SELECT count(*) AS n FROM (SELECT src FROM ps UNION SELECT dst FROM ps)) SELECT DISTINCT party, CAST(n * 8 * (2 + 2 * 128 * 15 + 128) AS BIGINT) AS bytes FROM split CROSS JOIN n")
def comm_bytes(spark, sf_dir):
    split = split_part_supp(spark, sf_dir)
    return factor.communication(split, embeddings.nodes_of(graphs.part_supp(spark, sf_dir)), 128, 7)


@query("SELECT CAST(vec_id AS VARCHAR) AS node, CAST(k AS BIGINT) AS k, round(v, 5) AS v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)")
def embedding_dictionary(spark, sf_dir):
    emb = graphs.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vec"))
    cells = factor.as_dictionary(emb).select("node", F.posexplode(F.from_json("vec", "array<float>")).alias("k", "v"))
    return cells.select("node", F.col("k").cast("long").alias("k"), rounded(F.col("v").cast("double"), 5).alias("v"))


# Evaluation.

#: Labels of customers: the nation, and 100 more than the rank of the segment.
TRUTH = """seg AS (SELECT c_mktsegment, 100 + row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)),
truth AS (SELECT c_custkey * 2 AS node, c_nationkey AS label FROM customer UNION ALL SELECT c_custkey * 2, CAST(code AS INTEGER) FROM customer JOIN seg USING (c_mktsegment)),
names AS (SELECT DISTINCT label FROM truth), scores AS (SELECT c_custkey * 2 AS node, label, (c_custkey * 7919 + label * 104729) % 1000003 / 1000003.0::DOUBLE AS p FROM customer, names),
k AS (SELECT node, count(*) AS k FROM truth GROUP BY node), r AS (SELECT node, label, row_number() OVER (PARTITION BY node ORDER BY p DESC, label) AS r FROM scores),
top AS (SELECT r.node, label FROM r JOIN k ON r.node = k.node WHERE r <= k),
cells AS (SELECT coalesce(t.label, p.label) AS label, t.node IS NOT NULL AS t, p.node IS NOT NULL AS p FROM truth t FULL JOIN top p ON t.node = p.node AND t.label = p.label),
c AS (SELECT label, count(*) FILTER (t AND p) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM cells GROUP BY label)"""


def customer_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """truth (node, label) with two labels a customer, and given scores (node, label, p)."""
    c = graphs.table(spark, sf_dir, "customer")
    codes = graphs.coded(c, "c_mktsegment")
    node = (F.col("c_custkey") * 2).alias("node")
    truth = c.select(node, F.col("c_nationkey").alias("label")).unionByName(c.join(codes, "c_mktsegment").select(node, (F.col("code") + 100).cast("int").alias("label")))
    labels = truth.select("label").distinct().agg(F.collect_list("label").alias("labels"))  # one row: segments and nations are a handful at every scale
    scores = c.select("c_custkey").join(labels).select("c_custkey", F.explode("labels").alias("label"))
    return truth, scores.select(node, "label", (mix_key(F.col("c_custkey"), F.col("label").cast("long")) / F.lit(1000003.0)).alias("p"))


def customer_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, scores = customer_labels(spark, sf_dir)
    return evaluate.confusion(evaluate.topk(scores, truth), truth)


@query(f"WITH {CS} SELECT DISTINCT src AS node FROM cs WHERE src IN (SELECT c_custkey * 2 FROM customer)")
def labelled_nodes(spark, sf_dir):
    truth, _ = customer_labels(spark, sf_dir)
    return evaluate.labelled(embeddings.nodes_of(graphs.cust_supp(spark, sf_dir)), truth)


@query("WITH r AS (SELECT c_custkey * 2 AS node, row_number() OVER (ORDER BY (c_custkey * 2 * 7919) % 1000003, c_custkey * 2) AS r, count(*) OVER () AS n FROM customer) SELECT node, r <= floor(0.3 * n) AS train FROM r")
def train_test_prefix(spark, sf_dir):
    return evaluate.split_prefix(graphs.table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("node")), 0.3)


@query(f"WITH {TRUTH} SELECT node, label FROM top")
def topk_labels(spark, sf_dir):
    truth, scores = customer_labels(spark, sf_dir)
    return evaluate.topk(scores, truth)


@query(f"WITH {TRUTH} SELECT label, tp, fp, fn FROM c")
def label_confusion(spark, sf_dir):
    return customer_confusion(spark, sf_dir)


@query(f"WITH {TRUTH} SELECT round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM c")
def f1_micro(spark, sf_dir):
    return vals(evaluate.micro_f1(customer_confusion(spark, sf_dir)), "micro_f1")


@query(f"WITH {TRUTH} SELECT round(avg(2.0 * tp / (2 * tp + fp + fn)), 6) AS macro_f1 FROM c")
def f1_macro(spark, sf_dir):
    return vals(evaluate.macro_f1(customer_confusion(spark, sf_dir)), "macro_f1")


@query(f"WITH {TRUTH} SELECT round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1, 2::BIGINT AS times FROM c")
def result_file(spark, sf_dir):
    """A result appended to a file twice, and read again."""
    path = new_folder(spark)
    for _ in range(2):
        graphs.append_results(vals(evaluate.micro_f1(customer_confusion(spark, sf_dir)), "micro_f1"), path)
    return spark.read.csv(path, header=True, schema="micro_f1 double").groupBy("micro_f1").agg(F.count(F.lit(1)).alias("times"))


def trade_halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tp = graphs.nation_trade(spark, sf_dir)
    return tp.filter("party = 1").select("i", "j", "v"), tp.filter("party = 2").select("i", "j", "v")


@query(f"WITH {TRADE} SELECT round(avg(abs(a.v - b.v)), 6) AS mae FROM tp a JOIN tp b ON a.i = b.i AND a.j = b.j AND a.party = 1 AND b.party = 2")
def mae(spark, sf_dir):
    return vals(evaluate.mean_absolute_error(*trade_halves(spark, sf_dir)), "mae")


@query(f"WITH {TRADE} SELECT round(100 * avg(abs((b.v - a.v) / nullif(a.v, 0))), 6) AS mape FROM tp a JOIN tp b ON a.i = b.i AND a.j = b.j AND a.party = 1 AND b.party = 2")
def mape(spark, sf_dir):
    return vals(evaluate.mean_percentage_error(*trade_halves(spark, sf_dir)), "mape")


#: Train fractions and repeats of an evaluation.
FRACTIONS, REPEATS = [k / 10 for k in range(1, 10)], 10


@query("SELECT unnest([0.5, 0.7, 0.9])::DOUBLE AS fraction, 1.0::DOUBLE AS micro_f1, 1.0::DOUBLE AS macro_f1, (SELECT count(DISTINCT n_regionkey) FROM customer JOIN nation ON c_nationkey = n_nationkey) + (SELECT count(DISTINCT c_mktsegment) FROM customer) AS labels")
def planted_classification(spark, sf_dir):
    """Customers by region and segment, two labels each, from vectors that tell both: nothing may be got wrong."""
    c = graphs.table(spark, sf_dir, "customer").join(graphs.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(graphs.coded(graphs.table(spark, sf_dir, "customer"), "c_mktsegment"), "c_mktsegment")
    two = c.select((F.col("c_custkey") * 2).alias("node"), F.array(F.col("n_regionkey").cast("int"), (F.col("code") + 100).cast("int")).alias("labels"))
    truth = two.select("node", F.explode("labels").alias("label"))
    labels = [r["label"] for r in truth.select("label").distinct().orderBy("label").collect()]  # ten
    vectors = two.select("node", F.array(*[F.array_contains("labels", F.lit(x)).cast("double") for x in labels]).alias("vec"))
    return vals(evaluate.classify(vectors, truth, [0.5, 0.7, 0.9], repeats=2), "micro_f1", "macro_f1").withColumn("labels", F.lit(len(labels)).cast("long"))


@query("SELECT 0.5::DOUBLE AS fraction, 1.0::DOUBLE AS micro_f1, 1.0::DOUBLE AS macro_f1, (SELECT count(DISTINCT month(o_orderdate) * 8 + dayofweek(o_orderdate)) + count(DISTINCT o_orderpriority) FROM orders) AS labels")
def banded_classification(spark, sf_dir):
    """Orders by month with day of the week, and by priority, labels fitted in two bands by truncated steps, from vectors of the first's binary digits and of the priority: nothing may be got wrong."""
    o = graphs.table(spark, sf_dir, "orders")
    day = F.month("o_orderdate") * 8 + F.dayofweek("o_orderdate")
    o = o.join(graphs.coded(o, "o_orderpriority"), "o_orderpriority").select((F.col("o_orderkey") * 2).alias("node"), day.alias("day"), F.col("code").cast("int").alias("code"))
    truth = o.select("node", F.explode(F.array("day", F.col("code") + 1000)).alias("label"))
    digits = [F.shiftright("day", b).bitwiseAND(F.lit(1)) * 2.0 - 1.0 for b in range(7)]
    vectors = o.select("node", F.array(*digits, *[(F.col("code") == k).cast("double") for k in range(5)]).alias("vec"))
    got = vals(evaluate.classify(vectors, truth, [0.5], c=100.0, numbers=850), "micro_f1", "macro_f1")
    return got.withColumn("labels", F.lit(truth.select("label").distinct().count()))


@query("SELECT CAST(k / 10.0 AS DOUBLE) AS fraction, true AS chance, true AS whole FROM range(1, 10) r(k)")
def node_classification(spark, sf_dir):
    """The labels of the vectors, learned from each fraction of them ten times. These tables draw them at random, so they are found as often as by chance, within 0.15."""
    rows = graphs.table(spark, sf_dir, "embeddings")
    labels = rows.select("label").distinct().count()
    got = evaluate.classify(rows.select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("vec")), rows.select(F.col("vec_id").alias("node"), "label"), FRACTIONS, repeats=REPEATS)
    return got.select("fraction", (F.abs(F.col("micro_f1") - F.lit(1.0 / max(1, labels))) < 0.15).alias("chance"), F.col("macro_f1").between(0, 1).alias("whole"))


@query(f"WITH {STAR}, n AS (SELECT count(*) AS n FROM d) SELECT 'sampled' AS model, 'customers' AS task, 0.5::DOUBLE AS fraction, true AS found, 2 AS parties, CAST(2 * n * 8 * (2 + 2 * {FULL} * 5 + {FULL}) AS BIGINT) AS communication FROM n")
def evaluation_report(spark, sf_dir):
    """The record of a run: customers' nations, from an embedding that two parties sample together, of which most must be found. Its time is left out."""
    split = cut(E.symmetrize(E.split_parties(graphs.customer_nations(spark, sf_dir), 2)))
    truth = graphs.table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("node"), F.col("c_nationkey").alias("label"))
    record = embeddings.evaluated(split, truth, FULL, model="sampled", task="customers", fractions=[0.5], parties=2, per_edge=64, workers=1, rounds=2)
    return record.select("model", "task", "fraction", (F.col("micro_f1") > 0.5).alias("found"), "parties", "communication")


# Generated graphs.


@query("""WITH n AS (SELECT count(*) AS n FROM supplier), u AS (SELECT i, j FROM range((SELECT n FROM n)) a(i), range((SELECT n FROM n)) b(j) WHERE i <= j AND ('0x' || substr(md5('1:' || i || ':' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.5)
SELECT i, j, 1.0::DOUBLE AS v FROM u UNION ALL SELECT j, i, 1.0::DOUBLE FROM u WHERE i < j""")
def random_symmetric(spark, sf_dir):
    """A generated matrix with a row for each supplier."""
    return graphs.random_symmetric(spark, graphs.table(spark, sf_dir, "supplier").count(), 1)


@query("WITH n AS (SELECT count(*) AS n FROM customer), b AS (SELECT b, least(64, n - b * 64) AS k FROM n, range((SELECT (n + 63) // 64 FROM n)) r(b)) SELECT b AS block, CAST(k * k AS BIGINT) AS cells, true AS within, true AS spread FROM b")
def mask_entries(spark, sf_dir):
    """Of each block of a mask over customers: its cells, that all lie in [0, 10), and that their mean is about 5."""
    cells = masks.random_matrix(spark, graphs.table(spark, sf_dir, "customer").count(), 3, 64)
    within = F.min(F.floor(F.col("i") / 64) == F.floor(F.col("j") / 64)) & (F.min("v") >= 0) & (F.max("v") < 10)
    return cells.groupBy(F.floor(F.col("i") / 64).alias("block")).agg(F.count(F.lit(1)).alias("cells"), within.alias("within"), (F.abs(F.avg("v") - 5) < 15 / F.sqrt(F.count(F.lit(1)))).alias("spread"))


@query("""WITH n AS (SELECT count(*) AS n FROM supplier), u AS (SELECT i, j FROM range((SELECT n FROM n)) a(i), range((SELECT n FROM n)) b(j)
WHERE i < j AND ('0x' || substr(md5('5:' || i || ':' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < CASE WHEN i % 3 = j % 3 THEN 0.5 ELSE 0.1 END)
SELECT i AS src, j AS dst, CAST(i % 3 AS INTEGER) AS label FROM u UNION ALL SELECT j, i, CAST(j % 3 AS INTEGER) FROM u""")
def planted_partition(spark, sf_dir):
    """A generated graph of three communities with a node for each supplier, with the labels of its edges' sources."""
    edges, _ = graphs.planted_partition(spark, graphs.table(spark, sf_dir, "supplier").count(), 3, 0.5, 0.1, 5)
    return edges.select("src", "dst", graphs.community("src", 3).alias("label"))
