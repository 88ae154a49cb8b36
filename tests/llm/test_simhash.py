"""SimHash groups against plain Python."""

import random
import re

import numpy as np
import pytest
import xxhash

from meshvec.llm import queries, simhash

DOCS = "doc_id long, text string, fingerprint string, fp long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius):
    """The place of the first of each group, by comparing all pairs."""
    x = np.array(prints, np.uint64)
    root = list(range(len(x)))
    for i in range(len(x)):
        todo = [i] if root[i] == i else []
        seen = set(todo)
        while todo:
            k = todo.pop()
            for j in np.flatnonzero(np.bitwise_count(x ^ x[k]) <= radius).tolist():
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        for j in seen:
            root[j] = min(root[j], i)
    return root


def plain_rows(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    root = plain_groups(prints, 4)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, root, strict=True)), key=repr)


def grouped(spark, rows):
    return sorted((tuple(r) for r in simhash.simhash_groups(docs(spark, rows)).collect()), key=repr)


def test_equals_comparison_of_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for base in range(12):
        text = rng.choices(words, k=rng.choice((3, 30, 120, 400)))
        for _ in range(12):
            copy = list(text)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) + 10, " ".join(copy)))
    rows += [(3, None), (4, ""), (5, " \t\n"), (6, "Über ÄB c d"), (7, "A b"), (8, "a\x0bB"), (9, "one"), (9, "one"), (None, "one"), (None, None), (None, "alone here")]
    rng.shuffle(rows)
    assert grouped(spark, rows) == plain_rows(rows)


def test_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op11_pivot_simhash(spark, sf_dir).collect()), key=repr)
    assert got == plain_rows(rows)
    assert len({r[2] for r in got}) < len(got)


@pytest.mark.parametrize("block", [4, 4096])
def test_groups_of_fingerprints(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    prints = []
    for _ in range(25):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice((1, 4, 40))):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            prints.append(x)
    chain = rng.getrandbits(64)  # each four bits from the one before, and one of five
    for k in range(0, 40, 4):
        prints.append(chain)
        chain ^= 0b1111 << k
    prints.append(chain ^ (1 << 63))
    prints = sorted(set(prints) | {0, 2**64 - 1})
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)), 1 + k % 3) for k, p in enumerate(prints)], "fp long, docs long")
    label = {r["id"]: r["label"] for r in simhash.hamming_groups(frame).collect()}
    want = {}
    for p, r in zip(prints, plain_groups(prints, 4), strict=True):
        want.setdefault(r, []).append(int(np.uint64(p).view(np.int64)))
    got = {}
    for p in prints:
        s = int(np.uint64(p).view(np.int64))
        got.setdefault(label.get(s, s), []).append(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(k == min(v) for k, v in got.items())


def test_keys_tell_all_segments_apart():
    """Part distances are as selective as the bits, and no pair within the radius is without a common key."""
    for s, mask in enumerate(simhash.masks().tolist()):
        low = (mask & -mask).bit_length() - 1
        values = np.arange(1 << mask.bit_count(), dtype=np.uint64) << np.uint64(low)
        assert len(np.unique(simhash.part_distances(values)[:, s, :], axis=0)) == len(values)
    rng = random.Random(2)
    for d in range(5):
        x = np.array([rng.getrandbits(64) for _ in range(500)], np.uint64)
        y = x ^ np.array([sum(1 << b for b in rng.sample(range(64), d)) for _ in x], np.uint64)
        assert (simhash.keys(x, 4) == simhash.keys(y, 4)).any(1).all()
        assert (np.abs(simhash.pivot_table(x) - simhash.pivot_table(y)).max(1) <= d).all()


def test_empty_and_long(spark):
    assert grouped(spark, []) == []
    text = "ab cd, " * 400_000
    assert grouped(spark, [(1, text), (2, "x" * 2_000_000)]) == [(i, f"{plain_fingerprint(t):016x}", i) for i, t in ((1, text), (2, "x" * 2_000_000))]


def test_hubs_do_not_meet_themselves(spark, monkeypatch):
    """A hub is a member of its key without a join: only the others meet it, and a link found under several keys passes once."""
    real, seen = simhash.connected, []
    monkeypatch.setattr(simhash, "connected", lambda links: seen.append(links.collect()) or real(links))
    prints = [0, 1, 2, 1 << 40]
    frame = spark.createDataFrame([(p, 9 if p == 0 else 1) for p in prints], "fp long, docs long")
    assert {r["id"]: r["label"] for r in simhash.hamming_groups(frame).collect()} == {1: 0, 2: 0, 1 << 40: 0}
    found = [tuple(sorted(r)) for r in seen[0]]
    assert len(found) == len(set(found)) and all(u != v for u, v in found)
