"""SimHash fingerprints of texts, and the groups that small Hamming distances link, by pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshvec.llm.common import cut, shuffles_dropped
from meshvec.llm.neardup import _large_groups, _of_group, connected, mix

SEED = 42
#: Hashes whose bits are counted at once.
SLICE = 1 << 15
#: Reference fingerprints (pivots), and the segments of the 64 bits on which their distances are told apart.
PIVOTS, SEGMENTS = 32, 7
#: A verifying task compares two blocks of at most so many fingerprints.
BLOCK = 4096
#: A key is large if it has one in HOT_SHARE or more of all memberships, so no more than HOT_SHARE are.
HOT_SHARE = 1000


def fingerprint(text: str | None, words: int = 4) -> int:
    """The unsigned SimHash of a text: a bit is 1 if it is set in over half of the XXH64 values of its shingles, repeats included.

    A-Z are lower-cased; words are parted by space and tab to carriage return;
    fewer words than a shingle make one; none give 0.
    """
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: both mean ASCII only
    if not found:
        return 0
    k = min(words, len(found))
    joined, hashed = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = [0, *ends[: len(found) - k].tolist()]
    stops = (ends[k - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), SLICE):
        h = np.array([hashed(joined[s:e], SEED) for s, e in zip(starts[at : at + SLICE], stops[at : at + SLICE], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def pivots() -> np.ndarray:
    """The reference fingerprints: fixed 64-bit words by a rule."""
    return mix(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def masks() -> np.ndarray:
    """The bits of each segment."""
    edges = [64 * s // SEGMENTS for s in range(SEGMENTS + 1)]
    return np.array([(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)], np.uint64)


def part_distances(prints: np.ndarray) -> np.ndarray:
    """Fingerprints by segments by pivots: the Hamming distances on each segment. Added up over segments they are the pivot distance table."""
    return np.bitwise_count((prints[:, None, None] ^ pivots()[None, None, :]) & masks()[None, :, None])


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """Fingerprints by pivots: the Hamming distances."""
    return np.bitwise_count(prints[:, None] ^ pivots()[None, :]).astype(np.int8)


@lru_cache(maxsize=None)
def meetings(radius: int) -> tuple[tuple[int, ...], ...]:
    """The choices of segments of which linked fingerprints agree in at least one: radius bits touch at most radius segments."""
    if not 0 <= radius < SEGMENTS:
        raise ValueError(f"links reach over 0 to {SEGMENTS - 1} bits")
    return tuple(combinations(range(SEGMENTS), SEGMENTS - radius))


def keys(prints: np.ndarray, radius: int) -> np.ndarray:
    """Fingerprints by meetings: a hash of the pivot distances on the chosen segments, which are equal where the segments are."""
    weights = mix(np.arange(1, PIVOTS + 1, dtype=np.uint64))
    codes = (part_distances(prints).astype(np.uint64) * weights).sum(2, dtype=np.uint64)  # fingerprints by segments
    out = np.empty((len(prints), len(meetings(radius))), np.uint64)
    for k, chosen in enumerate(meetings(radius)):
        h = np.full(len(prints), k + 1, np.uint64)
        for s in chosen:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[:, s])
        out[:, k] = h
    return out


def block_links(prints: np.ndarray, labels: np.ndarray, sides: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what is within the radius and has different labels, within a block or, with two sides, across two.

    Members stand in the order of their distance to the first pivot. By the
    triangle inequality a partner's distance to any pivot differs by at most
    the radius, so a partner stands in a window of that order, and is discarded
    if its largest difference over all pivots is more. Survivors are verified.
    """
    across = bool(sides.min() != sides.max())
    tables = pivot_table(prints)
    order = np.argsort(tables[:, 0], kind="stable")
    prints, labels, sides, tables = prints[order], labels[order].copy(), sides[order], tables[order]
    stop = np.searchsorted(tables[:, 0], tables[:, 0] + radius, side="right")
    out = []
    for i in range(len(prints) - 1):
        js = np.arange(i + 1, stop[i])
        fit = labels[js] != labels[i]
        if across:
            fit &= sides[js] != sides[i]
        js = js[fit]
        for at in (slice(1, 8), slice(8, PIVOTS)):
            if len(js):
                js = js[np.abs(tables[js, at] - tables[i, at]).max(1) <= radius]
        if len(js):
            js = js[np.bitwise_count(prints[js] ^ prints[i]) <= radius]
        for j in js.tolist():
            if labels[j] != labels[i]:
                out.append((int(prints[i].view(np.int64)), int(prints[j].view(np.int64))))
                labels[labels == labels[j]] = labels[i]
    return out


def fingerprints(docs: DataFrame, *, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (as a signed long) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _memberships(prints: DataFrame, radius: int) -> DataFrame:
    """key, fp, docs: the keys under which each fingerprint meets all that may be linked with it. prints: fp, docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(meetings(radius))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                fp, docs = (part.column(k).to_numpy() for k in (0, 1))
                found = keys(fp.view(np.uint64), radius).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(np.repeat(fp, many)), pa.array(np.repeat(docs, many))], ["key", "fp", "docs"])

    return prints.select("fp", "docs").mapInArrow(run, "key long, fp long, docs long")


def _unsettled(others: DataFrame, hubs: DataFrame, labels: DataFrame, large: DataFrame) -> DataFrame:
    """key, fp, label, loose of the keys whose hubs and other members labels (id, label) don't join altogether; loose: a label other than the hub's. others: key, fp, hub; hubs: key, hub."""
    of = labels.withColumnRenamed("id", "fp")
    lead = cut(hubs.select("key", F.col("hub").alias("fp")).join(of, "fp", "left").select("key", "fp", F.coalesce("label", "fp").alias("label")))
    named = others.join(of, "fp", "left").select("key", "fp", F.coalesce("label", "fp").alias("label"))
    told = cut(_of_group(named, lead.select("key", F.col("label").alias("of")), large, "key").select("key", "fp", "label", (F.col("label") != F.col("of")).alias("loose")))
    unjoined = cut(told.filter("loose").select("key").distinct())
    return _of_group(told, unjoined, large, "key").unionByName(lead.join(unjoined, "key", "left_semi").withColumn("loose", F.lit(False)))


def _blocks(rows: DataFrame, large: DataFrame) -> DataFrame:
    """rows (key, fp, label, loose) copied to the pairs of blocks (b1, b2) of their key; side 1 is the second block's.

    Loose members meet all others, the rest only the loose ones, since they are
    joined already.
    """
    count = lambda which: F.ceil(F.count_if(which) / BLOCK).cast("int")
    sizes = cut(rows.groupBy("key").agg(count(F.col("loose")).alias("nl"), count(~F.col("loose")).alias("nr")))
    at = lambda blocks: F.pmod(F.xxhash64("fp"), blocks.cast("long")).cast("int")
    placed = _of_group(rows, sizes, large, "key").withColumn("b", F.when(F.col("loose"), at(F.col("nl"))).otherwise(F.col("nl") + at(F.greatest("nr", F.lit(1)))))
    copies = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nl") + F.when(F.col("loose"), F.col("nr")).otherwise(0) - 1)))
    return copies.select("key", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "fp", "label", (F.col("b") > F.col("o")).cast("int").alias("side"))


def _verified(blocks: DataFrame, radius: int) -> DataFrame:
    """u, v: links that join the linked members of each pair of blocks whose labels differ. A task holds one pair at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the columns of a pair that may go on in the next batch

        def links(rows: list[np.ndarray]) -> list[tuple[int, int]]:
            return block_links(rows[3].view(np.uint64), rows[4], rows[5], radius) if len(rows[3]) > 1 else []

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy() for c in batch.columns]
            if held:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            starts = np.flatnonzero(np.r_[True, np.any([r[1:] != r[:-1] for r in rows[:3]], axis=0)]).tolist()
            found = [x for a, b in zip(starts, starts[1:], strict=False) for x in links([r[a:b] for r in rows])]
            held = [r[starts[-1] :] for r in rows]
            yield batch_of(found)
        if held:
            yield batch_of(links(held))

    return blocks.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2", "fp").mapInArrow(run, "u long, v long")


def hamming_groups(prints: DataFrame, *, radius: int = 4) -> DataFrame:
    """id, label: of each fingerprint that is linked and isn't its group's smallest (as a signed number), that smallest one.

    prints: fp (distinct longs), docs. A fingerprint's part distances to the
    pivots make the keys under which linked ones meet. Every member of a key is
    compared with its hub first (the one that most documents have), so a key
    costs what it has members; what that leaves unjoined is compared in pairs
    of bounded blocks, through pivot tables. Only spanning links leave a task.
    """
    rows = _memberships(prints, radius)
    hubs = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("g"), F.max(F.struct("docs", "fp"))["fp"].alias("hub")).filter("g > 1"))
    total = hubs.agg(F.coalesce(F.sum("g"), F.lit(0))).first()[0]
    large = cut(hubs.filter(F.col("g") * HOT_SHARE >= total).select("key"))
    others = cut(_of_group(_memberships(prints, radius), hubs.select("key", "hub"), large, "key").filter("fp != hub").select("key", "fp", "hub"))  # a hub needs no meeting with itself
    near = others.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= radius).select("fp", "hub").distinct()
    labels = connected(near.select(F.col("hub").alias("u"), F.col("fp").alias("v")))
    loose = cut(_unsettled(others, hubs, labels, large))
    links = cut(_verified(_blocks(loose, large), radius))
    return connected(links.unionByName(labels.select(F.col("label").alias("u"), F.col("id").alias("v"))))


def simhash_groups(docs: DataFrame, *, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach) of every document.

    Two documents link if their fingerprints differ in at most `radius` bits.
    Equal fingerprints are joined by an aggregate; only different ones are
    compared. No link is lost.

    Defined cases: texts without words, null ones too, have fingerprint zero
    and link like any other; each row is a document, so rows of one id with
    different texts may be in different groups; a null id stays null and names
    no group, and a group of null ids alone has a null component_id; an empty
    table gives an empty result; further columns are not used.
    """
    with shuffles_dropped(docs.sparkSession):
        rows = cut(fingerprints(docs, words=words, id_col=id_col, text_col=text_col))
        prints = cut(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("docs")))
        labels = hamming_groups(prints, radius=radius)
        named = cut(prints.join(labels.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label")))
        least = cut(named.groupBy("label").agg(F.min("rep").alias("component_id")))
        facts = cut(_of_group(named.select("fp", "label"), least, _large_groups(named, "label"), "label").select("fp", "component_id"))
        large = _large_groups(rows, "fp")
    found = _of_group(rows, facts, large, "fp")
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
