"""Document fingerprints by Order MinHash, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshvec.llm.common import cut, let

#: In a packed long, the low bits hold a token's place and the rest a hash.
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1
#: Texts with more tokens than this hold the same hashes and their places in structs.
PACKED_TOKENS = 1 << PLACE_BITS
#: An id is hot if it has more rows than both HOT_LEAST and one in HOT_SHARE of all, so no more than HOT_SHARE ids are.
HOT_LEAST, HOT_SHARE = 10_000, 1000


def order_minhash(text: Column, *, k: int = 3, take: int = 2, bins_log2: int = 6) -> Column:
    """The Order MinHash sketch of a text: an array of longs, at most one for each of 2^bins_log2 bins.

    Tokens are runs of non-space characters, cut every 8, so texts without
    spaces have tokens too. Each k-mer of tokens gets its occurrence number
    (so repeats count), and the hash of both deals it into a bin and ranks it
    there. Of each bin the `take` smallest are put back in text order and
    hashed as a tuple. A bin agrees between two texts only if the same k-mers
    are smallest in it and stand in the same order, which follows the edit
    distance and not only the sets.

    One hash is split into bins (one permutation), so the work is
    proportional to the text and not to text times bins. Null and empty texts
    have an empty sketch. Hash and place share a long; in texts of more than
    2^24 tokens, whose places don't fit it, they are the fields of a struct,
    with the same hashes and order.
    """
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S{1,8}"), F.lit(0))

    def starts(items: Column, group) -> Column:
        """Places where group(item) changes in a sorted array."""
        return F.filter(F.sequence(F.lit(0), F.size(items) - 1), lambda i: (i == 0) | (group(F.get(items, i)) != group(F.get(items, i - 1))))

    def sketch(t: Column, item, hash_of, place_of) -> Column:
        """The sketch of tokens; item(h, place) holds the upper bits of a hash and a place."""

        def kmers(t: Column) -> Column:
            return F.sort_array(F.transform(t, lambda x, i: item(F.xxhash64(x, *[F.get(t, i + j) for j in range(1, k)]), i.cast("long"))))

        def numbered(p: Column) -> Column:
            def run(r: Column) -> Column:
                def of(s: Column, j: Column) -> Column:
                    def one(i: Column) -> Column:
                        own = F.get(p, i)
                        return item(F.xxhash64(hash_of(own), i - s).bitwiseAND(F.lit((1 << 63) - 1)), place_of(own))

                    return F.transform(F.sequence(s, F.coalesce(F.get(r, j + 1), F.size(p)) - 1), one)

                return F.sort_array(F.flatten(F.transform(r, of)))

            return let(starts(p, hash_of), run)

        def bin_of(x: Column) -> Column:
            return F.shiftright(hash_of(x), 63 - PLACE_BITS - bins_log2)

        def tuples(q: Column) -> Column:
            def one(s: Column) -> Column:
                own = bin_of(F.get(q, s))
                least = F.filter(F.slice(q, s + 1, F.lit(take)), lambda v: bin_of(v) == own)
                placed = F.array_sort(F.transform(least, lambda v: F.struct(place_of(v).alias("at"), hash_of(v).alias("h"))))
                return F.shiftleft(own, 32).bitwiseOR(F.xxhash64(F.transform(placed, lambda x: x["h"])).bitwiseAND(F.lit(0xFFFFFFFF)))

            return F.transform(starts(q, bin_of), one)

        return let(let(kmers(t), numbered), tuples)

    def packed(t: Column) -> Column:
        return sketch(t, lambda h, at: h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(at), lambda x: F.shiftright(x, PLACE_BITS), lambda x: x.bitwiseAND(F.lit(PLACE)))

    def wide(t: Column) -> Column:
        return sketch(t, lambda h, at: F.struct(F.shiftright(h, PLACE_BITS).alias("h"), at.alias("at")), lambda x: x["h"], lambda x: x["at"])

    none = F.array().cast("array<bigint>")
    return let(tokens, lambda t: F.when(F.size(t) == 0, none).when(F.size(t) <= PACKED_TOKENS, packed(t)).otherwise(wide(t)))


def likeness(a: Column, b: Column) -> Column:
    """The share of bins in which two sketches agree, among the bins that either fills; two empty sketches are alike."""
    bins = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 32)), F.transform(b, lambda x: F.shiftright(x, 32))))
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / bins)


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def next_ids(keys: DataFrame) -> DataFrame:
    """keys (k, distinct, and further columns) with next_k, the next smaller key, and for the smallest the largest.

    Keys are range-partitioned once and kept, so a key's neighbour is in its
    own range but for one key of each range; those take it from a table with
    one row for each range, which is why that table may be broadcast.
    """
    ranged = cut(keys.repartitionByRange(F.col("k")).withColumn("part", F.spark_partition_id()))
    inside = ranged.withColumn("next_k", F.lead("k").over(Window.partitionBy("part").orderBy(F.desc("k"))))
    tops = ranged.groupBy("part").agg(F.max("k").alias("top"))
    everything = Window.orderBy(F.desc("part"))
    tops = tops.select("part", F.lead("top").over(everything).alias("below"), F.max("top").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("first"))
    return inside.join(F.broadcast(tops), "part").select(*[c for c in keys.columns], F.coalesce("next_k", "below", "first").alias("next_k"))


def hot_ids(keys: DataFrame) -> DataFrame:
    """k, deals: the ids with so many rows that these are dealt over several tasks, of about HOT_LEAST rows each; HOT_SHARE rows at most. keys: k, rows."""
    total = keys.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot = keys.filter((F.col("rows") > HOT_LEAST) & (F.col("rows") > F.lit(total) / HOT_SHARE))
    return hot.select("k", F.ceil(F.col("rows") / HOT_LEAST).cast("int").alias("deals"))


def dealt(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """rows (k, text, ...) with the deal of each: 0 but for hot ids, whose rows are spread, copies of one text too."""
    spread = F.xxhash64("text") + F.spark_partition_id() * F.lit(7919)
    return rows.join(F.broadcast(hot), "k", "left").withColumn("deal", F.coalesce(F.pmod(spread, F.col("deals")).cast("int"), F.lit(0))).drop("deals")


def to_all_deals(rows: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """rows, which hold each key once, copied to all deals of it."""
    deals = F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1))
    return rows.join(F.broadcast(hot.withColumnRenamed("k", key)), key, "left").withColumn("deal", deals).drop("deals")


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text, an edited form of it, and compare them.

    The edited text has the last floor(n/3) of n code points replaced by the
    first as many of the next document in descending order of ids. Texts are
    sketched where they are read and shuffled once by id; the same shuffle
    serves both as a document and as the next one of another, and only the
    prefix that the edit needs, with the sketch, goes on to the other document.
    Ids with very many rows (null ids, say) are dealt over tasks, and what is
    next to them is copied to each deal.

    Defined cases: a null text is empty; a null id counts as the smallest
    possible id; of rows with one id, the text with the smallest hash stands
    for the next document, and each such row has a result; a single document
    is its own next; an empty table gives an empty result; further columns are
    not used.
    """
    lowest = F.lit(-(2**63))
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), lowest).alias("k"), text.alias("text"))
    keys = next_ids(base.groupBy("k").agg(F.max(F.char_length("text")).alias("n"), F.count(F.lit(1)).alias("rows")))
    nexts = keys.select(F.col("k").alias("prev_k"), "next_k", F.floor(F.col("n") / 3).cast("int").alias("need"))
    hot = hot_ids(keys)  # HOT_SHARE rows at most, so it may be broadcast
    by = ["k"] if hot.isEmpty() else ["k", "deal"]
    if "deal" in by:
        base, nexts = dealt(base, hot), to_all_deals(nexts, hot, "next_k")
    nexts = nexts.withColumnsRenamed({c: f"next_{c}" for c in by if c != "k"})
    sketched = base.select(*by, "text", order_minhash(F.col("text")).alias("sketch")).repartition(*by)
    given = (
        sketched.join(nexts, [sketched[c] == nexts[f"next_{c}"] for c in by])
        .select(F.col("prev_k").alias("k"), F.struct(F.xxhash64("text").alias("hash"), F.col("text").substr(F.lit(1), F.col("need")).alias("prefix"), F.col("sketch").alias("sketch")).alias("next"))
        .groupBy("k")
        .agg(F.min("next").alias("next"))
    )
    given = to_all_deals(given, hot, "k") if "deal" in by else given
    both = sketched.join(given, by).select("k", "text", "sketch", "next", F.char_length("text").alias("n"))
    third = F.floor(F.col("n") / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.col("n") - third), F.col("next.prefix").substr(F.lit(1), third))
    both = both.select("k", "n", "sketch", F.col("next.sketch").alias("next_sketch"), edited.alias("edited"))
    both = both.select("k", "n", "sketch", "next_sketch", F.sha2("edited", 256).alias("edited_sha256"), order_minhash(F.col("edited")).alias("edited_sketch"))
    return both.select(
        F.nullif(F.col("k"), lowest).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
