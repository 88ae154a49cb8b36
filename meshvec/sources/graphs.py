"""Graphs as edge tables: from text files, from relational tables, and generated ones.

An edge table has src, dst and, where weighted, w. Bipartite graphs tell their
two kinds of nodes apart by parity: 2 * id on the left, 2 * id + 1 on the right.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshvec.functions.columns import md5_below
from meshvec.functions.lineage import cut, global_rank


def edge_lines(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """line, file, block, src, dst of an edge list file or folder; src and dst are null where a line isn't two whole numbers.

    Spark reads a large file in pieces; block is the byte at which a line's
    piece begins, so with file it tells where to look.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    form = rf"^\s*([+-]?[0-9]+){re.escape(sep)}([+-]?[0-9]+)\s*$"
    numbers = [F.expr(f"try_cast(nullif(part{k}, '') as bigint)") for k in (1, 2)]
    cut_ = lines.select("*", *[F.regexp_extract("line", form, k).alias(f"part{k}") for k in (1, 2)])
    both = numbers[0].isNotNull() & numbers[1].isNotNull()  # a number of more than 64 bits is no node
    return cut_.select("line", "file", "block", F.when(both, numbers[0]).alias("src"), F.when(both, numbers[1]).alias("dst"))


def read_edge_list(spark: SparkSession, path: str, sep: str = " ", bad: str = "null") -> DataFrame:
    """src, dst of an edge list file or folder: two whole numbers a line. Files of parties written by write_parties keep their party column.

    A bad line is an edge of nulls, or is dropped (bad="drop"), or ends the
    query with its text and place (bad="fail"); rejected_lines lists them all.
    """
    if bad == "null":
        return spark.read.csv(path, sep=sep, schema="src BIGINT, dst BIGINT")
    rows = edge_lines(spark, path, sep)
    if bad == "drop":
        return rows.filter("src is not null").select("src", "dst")
    if bad != "fail":
        raise ValueError(f"bad lines are null, drop or fail, not {bad}")
    told = F.concat(F.lit("not an edge: "), F.col("line"), F.lit(" (in "), F.col("file"), F.lit(" from byte "), F.col("block").cast("string"), F.lit(" on)"))
    return rows.select(F.when(F.col("src").isNull(), F.raise_error(told).cast("long")).otherwise(F.col("src")).alias("src"), "dst")


def rejected_lines(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """line, file, block of the lines of an edge list that aren't two whole numbers."""
    return edge_lines(spark, path, sep).filter("src is null").select("line", "file", "block")


def write_parties(split: DataFrame, path: str, sep: str = " ") -> None:
    """One folder for each party, with its edges as text."""
    split.select("src", "dst", "party").write.mode("overwrite").partitionBy("party").csv(path, sep=sep)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_supp_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of text for each line item, as a graph extractor would write it; lines repeat."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"), "l_orderkey", "l_linenumber")


def part_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_supp_lines(spark, sf_dir).select("src", "dst").distinct()


def cust_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")).distinct()


def coded(names: DataFrame, column: str, code: str = "code") -> DataFrame:
    """The distinct names with their rank from 0 in their order."""
    ranked = global_rank(names.select(column).distinct(), [column], code).drop("n")
    return ranked.withColumn(code, F.col(code) - 1)


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users to event types, coded by rank of their names; directed, so event types are dead ends."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    return events.join(coded(events, "event_type"), "event_type").select((F.col("user_id") * 2).alias("src"), (F.col("code") * 2 + 1).alias("dst"))


def customer_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to their nations: a star for each nation, so the matrix has a low rank that is the same at every scale."""
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("src"), (F.col("c_nationkey").cast("long") * 2 + 1).alias("dst"))


def nation_trade(spark: SparkSession, sf_dir: str, parties: int = 2) -> DataFrame:
    """i, j, v, party: lines sold by suppliers of one nation to customers of another; the party is the order's number modulo parties, plus 1.

    Nations number 25 at every scale, so dense masks over them stay small while every line counts. Lines are read, joined and
    counted once: what is returned is a checkpoint of at most 25 x 25 rows a party.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("i"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("j"))
    bought = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "i")
    sold = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", "j").agg(F.count(F.lit(1)).alias("n"))
    joined = sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
    return cut(joined.groupBy("i", "j", (F.col("o_orderkey") % parties + 1).cast("int").alias("party")).agg(F.sum("n").cast("double").alias("v")))


def both_ways(upper: DataFrame, a: str, b: str) -> DataFrame:
    """Drawn pairs (a <= b) and their mirror images, from one drawing."""
    pair = lambda x, y: F.struct(F.col(x).alias(a), F.col(y).alias(b))
    ways = F.when(F.col(a) == F.col(b), F.array(pair(a, b))).otherwise(F.array(pair(a, b), pair(b, a)))
    return upper.select(F.inline(ways))


def random_symmetric(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """i, j, v of a random symmetric 0/1 matrix; each unordered pair is drawn once by an md5 hash that other engines can repeat, the diagonal included.

    Only the upper triangle is generated, and each row of it by its own task.
    """
    upper = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.col("id"), F.lit(n - 1).cast("long"))).alias("j"))
    drawn = upper.filter(md5_below(seed, 0.5, "i", "j"))
    return both_ways(drawn, "i", "j").withColumn("v", F.lit(1.0))


def community(node: str, communities: int) -> Column:
    """The label of a node of planted_partition, told from its number, so that labelled edges need no join."""
    return F.pmod(F.col(node), F.lit(communities)).cast("int")


def planted_partition(spark: SparkSession, n: int, communities: int, inside: float, across: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Symmetric edges that fall inside a community with one probability and across with another, drawn as in random_symmetric; labels (node, label)."""
    label = lambda c: community(c, communities)
    upper = spark.range(n - 1).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1).cast("long"))).alias("dst"))
    drawn = upper.filter(F.when(label("src") == label("dst"), md5_below(seed, inside, "src", "dst")).otherwise(md5_below(seed, across, "src", "dst")))
    return both_ways(drawn, "src", "dst"), spark.range(n).select(F.col("id").alias("node"), label("id").alias("label"))


def write_embedding(embedding: DataFrame, path: str) -> None:
    embedding.select("node", "vec").write.mode("overwrite").parquet(path)


def append_results(results: DataFrame, path: str) -> None:
    """Result records (one for each train fraction) as CSV lines, added to those that are there."""
    results.write.mode("append").csv(path, header=True)
