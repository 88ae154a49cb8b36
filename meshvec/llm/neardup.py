"""N-gram Jaccard join by parity sketches, and the groups of near copies that it links."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshvec.llm.common import cut, emptied, free_name, settle, shuffles_dropped

#: A verifying task compares two blocks of at most so many sets, and of at most so many bytes.
BLOCK_SETS, BLOCK_BYTES = 2048, 16 << 20
#: Sets that a task compares with one copy of their group's leader.
LEADER_SETS = 256
#: Null ids become numbers from here on inside the join, by their text.
NO_ID = 1 << 62
LEAST_BITS = 512
#: A signature is heavy if HEAVY_LEAST or more of every HEAVY_SAMPLE-th document show it and it makes up one in MAX_HEAVY or
#: more of all that they show; so no more than MAX_HEAVY are. Heavy signatures are dealt by document.
HEAVY_SAMPLE, HEAVY_LEAST, MAX_HEAVY = 64, 64, 10_000
#: A group is large if it has one in HOT_SHARE or more of all memberships, so no more than HOT_SHARE are.
HOT_SHARE = 1000
#: Times that leaders are followed to their own leaders, twice as far each time.
JUMPS = 2

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of 64-bit words over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; fewer words make one shingle, none an empty set.

    A-Z are lower-cased; words are parted by space and tab to carriage return.
    Word hashes are differences of a running polynomial over the bytes.
    """
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    solid = np.empty(len(b) + 2, np.int8)
    solid[0] = solid[-1] = 0
    solid[1:-1] = (b != 32) & ((b < 9) | (b > 13))
    edges = np.flatnonzero(np.diff(solid))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    word = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)
    k = min(words, len(word))
    out = np.full(len(word) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * _ODD + word[i : len(word) - k + 1 + i])
    return np.unique(out)


# Sizes are cut into bands [starts[j], starts[j+1]) as wide as 1/t. A pair belongs to the level of its larger set, so a
# set shows itself at its own level and, if it is large enough for that, at the next. Wider bands need fewer signatures,
# but smaller parts, which more unlinked sets share.


@lru_cache(maxsize=None)
def _starts(percent: int, j: int) -> int:
    if j == 0:
        return 1
    a = _starts(percent, j - 1)
    return a * 100 // percent + 1


@lru_cache(maxsize=None)
def parts(percent: int, level: int) -> tuple[int, int]:
    """Number of parts of a level, and how many of them may be empty before a set shows its empty ones too.

    Linked sets differ in at most d elements, so in at most d of d + 1 + e
    parts; of the e + 1 that agree, one isn't empty if a set has at most e
    empty ones. e is the least with which sets rarely have more.
    """
    top = _starts(percent, level + 1) - 1
    least = max(1, -(-_starts(percent, level) * percent // 100))
    d = 2 * top * (100 - percent) // (100 + percent)
    if d == 0:
        return 1, 0
    best = (2.0, d + 1, 0)
    for e in range(12):
        mean = (d + 1 + e) * math.exp(-least / (d + 1 + e))
        tail = 1 - sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(e + 1))
        best = min(best, (tail, d + 1 + e, e))
        if tail < 1e-4:
            return d + 1 + e, e
    return best[1:]


def levels(percent: int, n: int) -> list[int]:
    j = 0
    while _starts(percent, j + 1) <= n:
        j += 1
    return [j, j + 1] if n * 100 >= percent * _starts(percent, j + 1) else [j]


def _salt(k: int) -> np.uint64:
    return np.uint64(k * int(_ODD) & (1 << 64) - 1)


def signatures(elements: np.ndarray, percent: int) -> np.ndarray:
    """The keys under which a set meets every set that may be linked with it: the parity words of its parts, by level. An empty set has none."""
    if not len(elements):
        return np.zeros(0, np.uint64)
    found = []
    for level in levels(percent, len(elements)):
        p, spare = parts(percent, level)
        h = mix(elements + _salt(level + 1))
        part = ((h >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)
        order = np.argsort(part.astype(np.uint32), kind="stable")
        at = part[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        word = np.zeros(p, np.uint64)
        word[at[first].astype(np.int64)] = np.bitwise_xor.reduceat(mix(elements[order] ^ _ODD), first)
        full = np.zeros(p, bool)
        full[at[first].astype(np.int64)] = True
        keys = mix(mix(word + _salt(level + 1)) + np.arange(p, dtype=np.uint64) * _ODD)
        found.append(keys if p - len(first) > spare else keys[full])
    return np.concatenate(found)


def as_blob(elements: np.ndarray) -> bytes:
    return elements.astype("<u8").tobytes()


def from_blob(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u8")


def width_of(n: int) -> int:
    """Bits of the sketch of a set of n: a power of two of n or more."""
    return max(LEAST_BITS, 1 << (n - 1).bit_length())


def sketch(elements: np.ndarray) -> np.ndarray:
    """Parities as 64-bit words: each element flips one bit, so two sketches of one width differ in at most as many bits as their sets in elements."""
    bits = np.bincount((mix(elements) & np.uint64(width_of(len(elements)) - 1)).astype(np.int64), minlength=width_of(len(elements))) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def may_link(n: int, a: np.ndarray, m: int, b: np.ndarray, percent: int) -> bool:
    """Do the sizes and sketches of two sets leave room for a link? A wider sketch is folded to the other's width: its halves are XORed."""
    if min(n, m) * 100 < percent * max(n, m):
        return False
    w = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(s.reshape(-1, w), axis=0) for s in (a, b))
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64)) * (100 + percent) <= (n + m) * (100 - percent)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    same = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * same >= percent * (len(a) + len(b) - same)


def close_pairs(n: np.ndarray, sketches: list[np.ndarray], side: np.ndarray, label: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, the later j) of different labels that may_link doesn't rule out, within a block or, with two sides, across two."""
    widths = np.array([len(s) for s in sketches])
    across = bool(side.min() != side.max())
    for w in np.unique(widths):
        members = np.flatnonzero((widths == w) | (widths == 2 * w))
        folded = np.stack([np.bitwise_xor.reduce(sketches[m].reshape(-1, w), axis=0) for m in members])
        for a in range(len(members) - 1):
            i = members[a]
            later = np.arange(a + 1, len(members))
            js = members[later]
            fit = (np.minimum(n[js], n[i]) * 100 >= percent * np.maximum(n[js], n[i])) & ((widths[js] == w) | (widths[i] == w)) & (label[js] != label[i])
            if across:
                fit &= side[js] != side[i]
            later = later[fit]
            if len(later):
                apart = np.bitwise_count(folded[later] ^ folded[a]).sum(1, dtype=np.int64)
                js = members[later]
                js = js[apart * (100 + percent) <= (n[js] + n[i]) * (100 - percent)]
                if len(js):
                    yield int(i), js


def block_survivors(rows: list[tuple], percent: int) -> list[int]:
    """Places of rows (id, label, side, n, sketch) that have a close partner with another label."""
    alive = np.zeros(len(rows), bool)
    column = lambda k: np.array([r[k] for r in rows])
    for i, js in close_pairs(column(3), [np.frombuffer(r[4], np.uint64) for r in rows], column(2), column(1), percent):
        alive[i] = alive[js] = True
    return np.flatnonzero(alive).tolist()


def block_links(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links among rows (id, label, side, n, blob) that join what is linked and has different labels: one fewer than labels for each connected part.

    Close pairs are counted exactly, unless a chain of links joins them already.
    """
    sets = [from_blob(r[4]) for r in rows]
    labels = np.array([r[1] for r in rows])
    root = {x: x for x in labels.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, js in close_pairs(np.array([len(x) for x in sets]), [sketch(x) for x in sets], np.array([r[2] for r in rows]), labels, percent):
        for j in js.tolist():
            a, b = find(rows[i][1]), find(rows[j][1])
            if a != b and linked(sets[i], sets[j], percent):
                root[max(a, b)] = min(a, b)
                out.append((rows[i][0], rows[j][0]))
    return out


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """id, n (the set's size), key (a 128-bit digest of the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary())], ["id", "n", "key"])

    return docs.select("id", "text").mapInArrow(run, "id long, n long, key binary")


def _signature_rows(texts: DataFrame, words: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [signatures(s, percent) for s in (shingles(t, words) for t in part.column(1).to_pylist())]
                ids = np.repeat(part.column(0).to_numpy(), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(ids)], ["sig", "id"])

    return texts.select("id", "text").mapInArrow(run, "sig long, id long")


def _heavy_signatures(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """sig, hub: frequent signatures by a sample of documents, and the smallest sampled id that shows each; at most MAX_HEAVY rows, by what frequent means."""
    sample = texts.filter(F.pmod(F.xxhash64("id"), F.lit(HEAVY_SAMPLE)) == 0)
    counts = cut(_signature_rows(sample, words, percent).groupBy("sig").agg(F.count(F.lit(1)).alias("shown"), F.min("id").alias("hub")))
    shown = counts.agg(F.coalesce(F.sum("shown"), F.lit(0))).first()[0]
    return counts.filter((F.col("shown") >= HEAVY_LEAST) & (F.col("shown") * MAX_HEAVY >= shown)).select("sig", "hub")


def _meetings(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """c, id: the groups in which ids with a common signature meet; c is the smallest of them, or the hub of a heavy signature.

    Heavy signatures need no look at their other rows, so these are dealt by
    document; the rows of other signatures come together in one task each.
    """
    marked = rows.join(F.broadcast(heavy), "sig", "left")  # at most MAX_HEAVY rows
    dealt = marked.withColumn("deal", F.when(F.col("hub").isNull(), F.col("sig")).otherwise(F.xxhash64("sig", "id")))
    bucket = Window.partitionBy("deal")
    met = dealt.select("id", "hub", F.min("id").over(bucket).alias("least"), F.max("id").over(bucket).alias("most"))
    return met.filter("hub is not null or least != most").select(F.coalesce("hub", "least").alias("c"), "id").distinct()


def _set_rows(texts: DataFrame, words: int, name: str, form) -> DataFrame:
    """id, n, and form(set) as bytes in a column called name, of texts."""
    kinds = [pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(t, words) for t in part.column(1).to_pylist()]
                columns = (part.column(0), [len(s) for s in sets], [form(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "n", name])

    return texts.select("id", "text").mapInArrow(run, f"id long, n long, {name} binary")


def _large_groups(rows: DataFrame, key: str = "c") -> DataFrame:
    """The keys of large groups; at most HOT_SHARE rows, by what large means."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("g"))
    return cut(sizes.filter(F.col("g") * HOT_SHARE >= rows.count()).select(key))


def _of_group(rows: DataFrame, facts: DataFrame, large: DataFrame, key: str = "c") -> DataFrame:
    """rows (key, ...) with the facts (key, ...; one row for each key) of their group. Those of large groups stay where they are and get theirs by broadcast; the others are shuffled."""
    few = F.broadcast(large)
    here = rows.join(few, key, "left_semi").join(F.broadcast(facts.join(few, key, "left_semi")), key)
    return here.unionByName(rows.join(few, key, "left_anti").join(facts.join(few, key, "left_anti"), key))


def _by_leader(members: DataFrame, carried: DataFrame, name: str, large: DataFrame, judge) -> DataFrame:
    """The members (c, id), id != c, of which judge(leader's n and bytes, member's n and bytes) is true. carried: id, n, name (bytes).

    The set of the leader, whose id is c, is copied to tasks of LEADER_SETS
    members each, which pass by it one after another; so a group costs as many
    comparisons as it has members, spread over tasks, and a task holds one set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = leader = None
        for batch in batches:
            found = []
            for c, b, lead, id_, n, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if lead == 0:
                    key, leader = (c, b), (n, data)
                elif key == (c, b) and judge(*leader, n, data):
                    found.append((c, id_))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["c", "id"])

    sizes = members.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / LEADER_SETS).cast("int").alias("nb"))
    placed = _of_group(members, sizes, large).select("c", F.pmod(F.xxhash64("id"), F.col("nb").cast("long")).cast("int").alias("b"), F.lit(1).alias("lead"), "id")
    leaders = sizes.select("c", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"), F.lit(0).alias("lead"), F.col("c").alias("id"))
    rows = placed.unionByName(leaders).join(carried, "id").select("c", "b", "lead", "id", "n", name)
    return rows.repartition("c", "b").sortWithinPartitions("c", "b", "lead", "id").mapInArrow(run, "c long, id long")


def _near_leader(groups: DataFrame, sketches: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """c, id: for each document the smallest leader that its sketch may link it with, if any does."""

    def judge(n: int, a: bytes, m: int, b: bytes) -> bool:
        return may_link(n, np.frombuffer(a, np.uint64), m, np.frombuffer(b, np.uint64), percent)

    return _by_leader(groups.filter("id != c"), sketches, "sketch", large, judge).groupBy("id").agg(F.min("c").alias("c")).select("c", "id")


def _leader_links(near: DataFrame, blobs: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """u, v: the documents that are linked with the leader they are near to."""
    found = _by_leader(near, blobs, "blob", large, lambda n, a, m, b: linked(from_blob(a), from_blob(b), percent))
    return found.select(F.col("c").alias("u"), F.col("id").alias("v"))


def _followed(firm: DataFrame) -> DataFrame:
    """id, label: whom each document's leader's leader ... follows, 2^JUMPS steps on. Documents of one label are joined by links; what longer chains leave apart is compared in blocks."""
    labels = firm.select(F.col("v").alias("id"), F.col("u").alias("label"))
    for _ in range(JUMPS):
        further = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        labels = cut(labels.join(further, "label", "left").select("id", F.coalesce("next", "label").alias("label")))
    return labels


def _unsettled(groups: DataFrame, labels: DataFrame, large: DataFrame) -> DataFrame:
    """c, id, label, loose of the groups that labels (id, label) don't join altogether; loose: a label other than the leader's."""
    named = cut(groups.join(labels, "id", "left").select("c", "id", F.coalesce("label", "id").alias("label")))
    leaders = named.filter("id = c").select("c", F.col("label").alias("of"))
    told = cut(_of_group(named, leaders, large).select("c", "id", "label", (F.col("label") != F.col("of")).alias("loose")))
    open_ = told.filter("loose").select("c").distinct()
    return _of_group(told, open_, large)


def _blocks(rows: DataFrame, carried: DataFrame, name: str, large: DataFrame) -> DataFrame:
    """rows (c, id, label, loose) with carried (id, n, name: bytes), copied to the block pairs (b1, b2) of their group; side 1 is the second block's.

    Loose members meet all others, the rest only the loose ones: those are
    joined already. Loose members and others have as many blocks each as their
    number and bytes ask for, so each pair of blocks is bounded. Sizes are
    settled before the bytes join, which are then shuffled once for each copy.
    """
    sized = rows.join(carried.select("id", F.octet_length(name).alias("bytes")), "id")
    of = lambda which: F.greatest(F.ceil(F.count_if(which) / BLOCK_SETS), F.ceil(F.sum(F.when(which, F.col("bytes")).otherwise(0)) / BLOCK_BYTES)).cast("int")
    sizes = sized.groupBy("c").agg(of(F.col("loose")).alias("nl"), of(~F.col("loose")).alias("nr"), F.count(F.lit(1)).alias("g"))
    sizes = cut(sizes.filter("nl > 0 and g > 1").drop("g"))
    at = lambda blocks: F.pmod(F.xxhash64("id"), blocks.cast("long")).cast("int")
    placed = _of_group(rows, sizes, large).withColumn("b", F.when(F.col("loose"), at(F.col("nl"))).otherwise(F.col("nl") + at(F.greatest("nr", F.lit(1)))))
    copies = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nl") + F.when(F.col("loose"), F.col("nr")).otherwise(0) - 1)))
    pairs = copies.select("c", "id", "label", "loose", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), (F.col("b") > F.col("o")).cast("int").alias("side"))
    return pairs.join(carried, "id")


def _by_block(blocks: DataFrame, name: str, judge, ddl: str, kinds: list[pa.DataType]) -> DataFrame:
    """judge(c, rows) of each block pair, rows being tuples (id, label, side, n, bytes, loose); what it returns are rows of ddl."""
    names = [x.split()[0] for x in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done() -> pa.RecordBatch:
            found = judge(key[0], rows) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            cells = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*cells, strict=True):
                if row[:3] != key:
                    if rows:
                        yield done()
                    key, rows = row[:3], []
                rows.append(row[3:])
        if rows:
            yield done()

    columns = ["c", "b1", "b2", "id", "label", "side", "n", name, "loose"]
    return blocks.select(*columns).repartition("c", "b1", "b2").sortWithinPartitions("c", "b1", "b2", "id").mapInArrow(run, ddl)


def _survivors(rows: DataFrame, sketches: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """Those of rows (c, id, label, loose) that may link with a member of their group that has another label."""

    def judge(c: int, rows: list[tuple]) -> list[tuple]:
        return [(c, rows[k][0], rows[k][1], rows[k][5]) for k in block_survivors(rows, percent)]

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    return _by_block(_blocks(rows, sketches, "sketch", large), "sketch", judge, "c long, id long, label long, loose boolean", kinds).distinct()


def _verified(rows: DataFrame, blobs: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join the linked members of each group whose labels differ."""
    return _by_block(_blocks(rows, blobs, "blob", large), "blob", lambda c, rows: block_links(rows, percent), "u long, v long", [pa.int64(), pa.int64()])


def jaccard_links(docs: DataFrame, sets: DataFrame, *, words: int, percent: int) -> DataFrame:
    """Links (u, v) that connect exactly the documents that links of Jaccard similarity >= percent / 100 connect.

    docs: id, text. sets: the checkpointed shingle_sets of docs. Equal sets
    join through their smallest id at once; one text of each set goes on. It
    shows its signatures; sets under one signature meet in a group. Every
    member is first compared with its group's leader, so a group of copies
    costs what it has members. What that leaves unjoined is compared in pairs of
    bounded blocks, so a large group spreads over many tasks: first by
    sketches, which leaves those with a close partner, then by whole sets. Only
    a spanning set of links leaves a task. Every step ends in a stored table.
    """
    full = sets.filter("n > 0").select("id", "key")
    reps = cut(full.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("g")))
    equal = _of_group(full, reps.filter("g > 1").select("key", "rep"), _large_groups(full, "key"), "key").filter("id != rep").select(F.col("rep").alias("u"), F.col("id").alias("v"))
    texts = docs.select("id", "text")

    def of(ids: DataFrame) -> DataFrame:
        return texts.join(ids.distinct(), "id", "left_semi")

    heads = of(reps.select(F.col("rep").alias("id")))
    groups = cut(_meetings(_signature_rows(heads, words, percent), _heavy_signatures(heads, words, percent)))
    sketches = settle(_set_rows(of(groups.select("id")), words, "sketch", lambda s: sketch(s).tobytes()))
    large = _large_groups(groups)
    near = cut(_near_leader(groups, sketches, large, percent))
    blobs = settle(_set_rows(of(near.select("id").unionByName(near.select(F.col("c").alias("id")))), words, "blob", as_blob))
    firm = cut(_leader_links(near, blobs, large, percent))
    emptied(blobs)
    labels = _followed(firm)
    loose = cut(_unsettled(groups, labels, large))
    alive = cut(_survivors(loose, sketches, large, percent))
    emptied(sketches)
    blobs = settle(_set_rows(of(alive.select("id")), words, "blob", as_blob))
    links = cut(_verified(alive, blobs, large, percent))
    emptied(blobs)
    return links.unionByName(firm).unionByName(equal)


def connected(links: DataFrame) -> DataFrame:
    """id, label: the smallest id of each linked document's connected part, by large-star and small-star rounds.

    A round moves every link to the smallest neighbour; it ends when each
    document has one link, to one that has none of its own. Minima are
    aggregated map-side before the shuffle, so a hub costs one row of each task.
    """
    edges = cut(links.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).filter("a < b").distinct())
    while True:
        seen = edges.select(F.col("b").alias("x"), F.lit(1).alias("low")).unionByName(edges.select(F.col("a").alias("x"), F.lit(None).cast("int").alias("low")).distinct())
        if seen.groupBy("x").agg(F.count("low").alias("links"), F.count(F.lit(1)).alias("all")).filter("links > 1 or links = 1 and all > 1").isEmpty():
            return edges.select(F.col("b").alias("id"), F.col("a").alias("label"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        pairs = large.join(least, "b")
        small = pairs.filter("a != m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(least.select(F.col("m").alias("a"), "b"))
        edges = cut(small.filter("a < b").distinct())


def _known(id_col: str, text_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col).bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID)))


def _inner(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(_known(id_col, text_col).alias("id"), F.col(text_col).alias("text"))


def _labels(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The shingle_sets of docs, and (id, label) of the documents that have a smaller id in their group."""
    with shuffles_dropped(docs.sparkSession):
        inner = _inner(docs, id_col, text_col)
        sets = cut(shingle_sets(inner, words))
        return sets, connected(jaccard_links(inner, sets, words=words, percent=percent))


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) of every document.

    Two documents link if their sets of word shingles have a Jaccard similarity
    of percent / 100 or more. No link is lost; hashes of 64 bits stand for
    shingles.

    Defined cases: null, empty and blank texts have empty sets and link with
    nothing; fewer words than a shingle make one shingle; rows with one id are
    one document of the graph, linked if any of its texts is; ids are below
    2^62, and rows with a null id are told apart by their texts, never name a
    group that has an id, and stay null; an empty table gives an empty result;
    further columns are not used.
    """
    sets, labels = _labels(docs, words, percent, id_col, text_col)
    found = sets.join(labels, "id", "left").select("id", "n", F.coalesce("label", "id").alias("label"))
    named = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return found.select(named("id").alias("doc_id"), F.col("n").alias("n_shingles"), named("label").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group: the smallest id, and of its repeated rows any one of each text.

    Documents that link with nothing stay, rows without words among them with
    all their repeats. Repeated rows are dropped by an aggregate over (id, hash
    of the text), combined before its shuffle, so they never meet in one task.
    """
    sets, labels = _labels(docs, words, percent, id_col, text_col)
    key, digest = free_name(docs, "__id"), free_name(docs, "__digest")
    kept = docs.withColumn(key, _known(id_col, text_col)).join(labels.select(F.col("id").alias(key)).distinct(), key, "left_anti")
    if sets.filter("n > 0").groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").isEmpty():
        return kept.select(*docs.columns)
    worded = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    once = kept.filter(worded).withColumn(digest, F.sha2(F.col(text_col), 256)).dropDuplicates([key, digest])
    return once.select(*docs.columns).unionByName(kept.filter(~worded).select(*docs.columns))
