"""Classifiers by held-out accuracy, personal data against plain patterns, and the pipeline's stages."""

import functools
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meshvec.llm import pii, quality, queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


# Toxicity.


def test_interaction_is_learned():
    """Neither term alone is toxic, both together are: the factors must carry it."""
    rng = np.random.default_rng(0)
    x = (rng.random((2000, 12)) < 0.4).astype(np.float32)
    y = (x[:, 0] * x[:, 1]).astype(np.float32)
    bias, w, v = toxicity.fit(x[:1500], y[:1500], rounds=400)
    xv = x @ v
    z = bias + x @ w + 0.5 * ((xv**2).sum(1) - x @ (v**2).sum(1))
    assert ((z[1500:] > 0) == (y[1500:] > 0)).mean() > 0.97


def test_pairs_are_learned_from_texts(spark):
    """Toxic if two words are both there or both absent: neither tells anything alone, and an additive model can't do better than chance."""
    rng = random.Random(11)
    rows = []
    for i in range(2000):
        words = [f"w{rng.choice('abcdefghij')}{rng.choice('klmnopqrst')}x" for _ in range(30)]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join(words + ["insult"] * a + ["group"] * b), int(a == b)))
    d = docs(spark, [(i, t) for i, t, _ in rows])
    model = toxicity.train_toxicity(d, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), F.col("doc_id") < 1500)
    got = model.scores([t for i, t, _ in rows if i >= 1500])
    assert ((got >= 0.5) == np.array([y for i, _, y in rows if i >= 1500])).mean() > 0.95


def test_rare_insult_meets_its_group(spark):
    """An insult in 6 % of the texts, a group's name in 30 %: with the insult the label is whether the group is named, without it chance."""
    rng = random.Random(4)
    words = ["w" + "".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    rows = []
    for i in range(6000):
        text, insult, group = rng.choices(words, k=150), rng.random() < 0.06, rng.random() < 0.3
        text[3] = "zuttel" if insult else text[3]
        text[70] = "quorvan" if group else text[70]
        rows.append((i, " ".join(text), insult, int(group) if insult else int(rng.random() < 0.3)))
    d = docs(spark, [(i, t) for i, t, _, _ in rows])
    model = toxicity.train_toxicity(d, spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int"), F.col("doc_id") < 4000)
    held = [(t, y) for i, t, insult, y in rows if insult and i >= 4000]
    got = model.scores([t for t, _ in held])
    assert len(held) > 80 and ((got >= 0.5) == np.array([y for _, y in held])).mean() > 0.95


def test_interacting_pairs_equal_all_pairs(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK_TERMS", 3)
    monkeypatch.setattr(toxicity, "CHUNK_MEETINGS", 500)
    rng = np.random.default_rng(3)
    x = rng.random((600, 20)) < rng.uniform(0.05, 0.6, 20)
    y = (rng.random(600) < 0.2).astype(np.int64)
    both = x[:, 4] & x[:, 9]
    y[both] = 1
    x = x[:, np.argsort(x.sum(0), kind="stable")]
    flat, sizes = np.nonzero(x)[1], x.sum(1)
    want = {}
    for a in range(20):
        for b in range(a + 1, 20):
            together = x[:, a] & x[:, b]
            g = toxicity.gain(together.sum(), y[together].sum(), x[:, a].sum(), y[x[:, a]].sum(), x[:, b].sum(), y[x[:, b]].sum(), 600, y.sum())
            if together.sum() >= toxicity.LEAST_CELL and g >= toxicity.LEAST_GAIN:
                want[a, b] = float(g)
    got = {(a, b): g for part in range(3) for a, b, g in toxicity.interacting(y, flat, sizes, 20, part, 3)}
    assert got and set(got) <= set(want) and all(abs(g - want[k]) < 1e-6 for k, g in got.items())
    for part in range(3):  # the largest gain of each part stays
        own = {k: g for k, g in want.items() if k[0] % 3 == part}
        assert not own or max(own, key=own.get) in got
    assert toxicity.interacting(y, np.zeros(0, np.int64), np.zeros(600, np.int64), 0, 0, 1) == []


def test_scores_equal_the_double_sum():
    rng = np.random.default_rng(4)
    words = [f"word{c}" for c in "abcdefgh"]
    terms = {t: i for i, t in enumerate(sorted(set().union(*map(toxicity.word_terms, words))))}
    m = toxicity.FactorizationMachine(terms, 0.3, rng.normal(size=len(terms)), rng.normal(size=(len(terms), 5)))
    texts = [None, "", "unknown things", *(" ".join(rng.choice(words, k)) for k in (1, 2, 5, 30))]
    for text, score in zip(texts, m.scores(texts), strict=True):
        on = sorted({terms[t] for w in toxicity.words_of(text) for t in toxicity.word_terms(w) if t in terms})
        z = m.bias + sum(m.weights[i] for i in on) + sum(float(m.factors[i] @ m.factors[j]) for a, i in enumerate(on) for j in on[a + 1 :])
        assert score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(3)
    rows = []
    for i in range(900):
        words = [f"w{rng.randrange(400)}x" for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(("idiot", "scum", "loser"))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_held_out(spark, spoken):
    d = docs(spark, [(i, t) for i, t, _ in spoken])
    labels = spark.createDataFrame([(i, y) for i, _, y in spoken] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(d, labels, F.col("doc_id") < 600)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(d, model).collect()}
    right = sum((got[i] >= 0.7) == bool(y) for i, _, y in spoken if i >= 600)
    assert right >= 295
    kept = {r["doc_id"] for r in toxicity.drop_toxic(d, model).collect()}
    assert kept == {i for i in got if got[i] < 0.7}


def test_toxicity_edge_cases(spark):
    d = docs(spark, [(1, None), (2, ""), (3, "idiot " * 100_000), (3, "idiot " * 100_000), (None, "x")]).withColumn("score", F.lit("own"))
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    for y in (labels, labels.limit(0)):
        out = toxicity.score_toxicity(d, toxicity.train_toxicity(d, y, F.lit(True))).collect()
        assert len(out) == 5 and all(0 <= r["_score"] <= 1 and r["score"] == "own" for r in out)
    assert toxicity.score_toxicity(d.limit(0), toxicity.train_toxicity(d.limit(0), labels, F.lit(True))).count() == 0


def test_queries_hold_out(spark, sf_dir):
    import zlib

    for q, divisor, out in ((queries.op6_factorization_machine, 3, 1), (queries.op8_additive_model, 5, 0)):
        rows = q(spark, sf_dir).collect()
        assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
        for r in rows:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % divisor == out) and 0 <= r["score"] <= 1
            assert r["predicted"] == int(r["score"] >= (0.7 if divisor == 3 else 0.3))


# Quality.


def test_pairwise_interaction_is_learned():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.8


def test_quality_held_out(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rng = random.Random(5)
    rows = []
    for i in range(600):
        words = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 8))) for _ in range(80)]
        good = i % 3 > 0
        rows.append((i, " ".join(words) + "." if good else " | ".join(words) if i % 2 else "!! ".join(words).upper(), int(good)))
    d = docs(spark, [(i, t) for i, t, _ in rows])
    y = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = quality.train_quality(d, y, F.col("doc_id") < 400)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(d, model).collect()}
    assert all((got[i] >= 0.3) == bool(q) for i, _, q in rows if i >= 400)
    assert labels


def test_quality_held_out_labels(spark, sf_dir):
    """The labels of the tables, whose junk the features weren't made for."""
    sf = sf_dir.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op8_additive_model(spark, sf).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    for y in (0, 1):
        own = [r["predicted"] == y for r in rows if labels[r["doc_id"]] == y]
        assert len(own) > 5 and sum(own) / len(own) > 0.9


def test_score_equals_table_lookups():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 4))
    model = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float), cycles=10, pair_cycles=5)
    for row, score in zip(x[:50], model.score(x[:50]), strict=True):
        z = model.bias + sum(t[int((c <= v).sum())] for c, t, v in zip(model.cuts, model.tables, row, strict=True))
        z += sum(t[int((model.coarse[i] <= row[i]).sum()), int((model.coarse[j] <= row[j]).sum())] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert score == pytest.approx(1 / (1 + math.exp(-z)))


def test_quality_edge_cases(spark):
    d = docs(spark, [(1, None), (2, ""), (3, " \n"), (4, "é" * 200_000), (4, "x"), (None, "y")])
    empty = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.score_quality(d, quality.train_quality(d, empty, F.lit(True))).collect()
    assert len(out) == 6 and all(r["score"] == 0.5 for r in out)
    assert quality.score_quality(d.limit(0), quality.train_quality(d, empty, F.lit(True))).count() == 0
    assert all(np.isfinite(quality.text_features(t)).all() for t in (None, "", "a", "|||", "\n\n"))


# Personal data.

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m.group())) <= 15]


PIECES = ["a@b.c", "x.y+z@mail-1.example.co", "@", "a@", "@b.c", "a@b", "a@b.c@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "0001.2.3.4", "1..2.3.4", "4539578763621486", "4539 5787-6362 1486", "4539  578763621486", "+1 (212) 555-0143", "+1", "+12", "+1  ", "+1 (212) 555-0143 4539578763621486", "word", " ", "\n", "é", "-", "3", "."]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(8)
    for _ in range(4000):
        t = "".join(rng.choice(PIECES) + rng.choice(("", "", " ")) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_base_spans_are_linear():
    for t in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "@a" * 150_000, "+1" + " " * 300_000, "a@" * 100_000):
        pii.base_spans(t)


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return pii.train_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(0)
    text = "call +1 (212) 555-0143 or bob@site.example.org"
    lat, gold = pii.training_window(text, 0, len(text), pii.base_spans(text))
    k = len(pii.KINDS) + 1
    m = pii.SpanModel(rng.normal(0, 0.1, (pii.N_FEATURES, k - 1)), rng.normal(0, 0.1, 4), rng.normal(0, 0.1, (k, k)))
    like, g = pii.gradient(m, lat, gold)
    for name, at in (("spans", (0, 3)), ("spans", (7, 0)), ("outside", 1), ("after", (0, 4)), ("after", (1, 0))):
        w = getattr(m, name)
        w[at] += 1e-5
        moved, _ = pii.gradient(m, lat, gold)
        w[at] -= 1e-5
        assert (moved - like) / 1e-5 == pytest.approx(getattr(g, name)[at], abs=1e-3)


def test_model_adds_spans(model):
    text = "mail +1 (415) 555-0199 4024007198964305 and password=ab12cd34ef56ab78cd in 2024 with 123456 things"
    base, added = pii.find_spans(text, model)
    found = {(k, text[a:b]) for k, a, b in added}
    assert base == []
    assert {("phone", "+1 (415) 555-0199"), ("card", "4024007198964305"), ("secret", "ab12cd34ef56ab78cd")} <= found
    clean = "In 2024 some 123456 people read chapter 12 of version 3.11.4; see page 99871234 for more, or section 10."
    assert pii.find_spans(clean, model) == ([], [])


@pytest.mark.parametrize("before,secret,after", [("login password=", "a1b2c3d4e5f6", " now"), ("token: ", "Zx9kQ2mB7pL4w", " was given"), ('api_key = "', "k8f7d6s5a4q3", '" in it'), ("a pwd=", "h4j5k6l7", " of old")])
def test_short_named_secrets_are_found(model, before, secret, after):
    text = "plain words go before it, " * 5 + before + secret + after + ", and plain words go after it" * 5
    base, added = pii.find_spans(text, model)
    assert base == [] and [(k, text[a:b]) for k, a, b in added] == [("secret", secret)]
    assert secret not in pii.mask_text(text, added)


def test_unnamed_short_runs_stay(model):
    assert pii.find_spans("the plane b747x200 left gate b12 at 10:45, with chapter 3 of v2 of abc4defg and 7 people", model) == ([], [])


@pytest.mark.parametrize("text", ["a1 b2@c.d", "+1 (2) 345", "key=abc12def4", "x\n12 34-5", "1.2.3.4 9"])
def test_decoding_equals_all_segmentations(text):
    """By plain recursion over every way to cut a short window into outside tokens and segments of each kind."""
    rng = np.random.default_rng(len(text))
    k = len(pii.KINDS) + 1
    for _ in range(5):
        m = pii.SpanModel(rng.normal(0, 1, (pii.N_FEATURES, k - 1)), rng.normal(0, 1, 4), rng.normal(0, 1, (k, k)))
        lat = pii.lattice(text, 0, len(text))
        n = len(lat.outside)

        @functools.cache
        def best(j, y):
            """The best score and spans of the tokens before j, if what ends at j has kind y."""
            if j == 0:
                return (0.0, []) if y == 0 else (-np.inf, [])
            if y == 0:
                return max(((s + m.after[x, 0] + lat.outside[j - 1] @ m.outside, spans) for x in range(k) for s, spans in [best(j - 1, x)]), key=lambda r: r[0])
            found = [(s + m.after[x, y] + f @ m.spans[:, y - 1], [*spans, (pii.KINDS[y - 1], lat.starts[i], lat.starts[j])]) for i, f in lat.segments[j] for x in range(k) for s, spans in [best(i, x)]]
            return max(found, key=lambda r: r[0], default=(-np.inf, []))

        assert m.decode(text, 0, len(text)) == max((best(n, y) for y in range(k)), key=lambda r: r[0])[1]


def test_windows_hold_every_candidate():
    rng = random.Random(6)
    for _ in range(300):
        t = " ".join(rng.choice((*PIECES, "a1b2c3d4", "password=", "é9", "word_7", "long" * 8)) for _ in range(rng.randint(0, 40)))
        held = pii.windows(t)
        assert all(any(a <= i < b for a, b in held) for i, c in enumerate(t) if c in "@0123456789")


def plain_features(s: str, tokens: list[str], i: int, j: int, named: bool) -> np.ndarray:
    f = np.zeros(pii.N_FEATURES)
    d = pii._digits(s)
    before, after = tokens[i - 1] if i else " ", tokens[j] if j < len(tokens) else " "
    mail = pii.AT_DOMAIN.search(s) if "@" in s else None
    f[0] = 1
    f[1] = bool(mail) and mail.end() == len(s) and mail.start() > 0 and all(c in pii.LOCAL for c in s[: mail.start()])
    f[2] = s.count(".") == 3 and len(d) == len(s) - 3 and list(pii.ips(s)) == [(0, len(s))]
    f[3] = bool(pii.CARD.fullmatch(s)) and 13 <= len(d) <= 19 and pii.luhn(d)
    f[4] = s[0] == "+" and bool(pii.PHONE.fullmatch(s)) and 9 <= len(d) <= 15
    f[5] = f[4] and len(d) == 11
    f[6] = f[3] and len(d) == 16
    f[7] = (j - i) / pii.MOST_TOKENS
    f[8] = len(d) / len(s)
    f[9] = len(s) >= 8 and 0 < len(d) < len(s) and bool(re.fullmatch(r"[A-Za-z0-9_]+", s))
    f[10] = f[9] and pii._entropy(s) > 2.5
    f[11] = named
    f[12] = named and f[9]
    f[13] = before[-1:].isspace() or before in "\"'=:(<[,;"
    f[14] = after[:1].isspace() or after in "\"'),.;>]"
    f[15] = before[-1:] in "._%+-@" and not before.isspace()
    f[16] = after[:1] in "._-@" and not after.isspace()
    f[17] = j - i == 1
    f[18] = any(t.isspace() for t in tokens[i:j])
    f[19] = bool(before) and before[-1:].isalnum() or after[:1].isalnum()
    return f


def test_segments_equal_plain_features():
    """All candidate segments of a window and their features, one by one from the tokens."""
    rng = random.Random(7)
    parts = ["a1@b.c ", "1000 ", "+1 (212) 555-0143", "4539578763621486", "password=", "q8r7t6y5u4", " ", "\n", "x", "_1.", "é", "10.2.3.4", ":", "token", " = ", '"', "-", "9", "Ab", "(", ")", "%", "'"]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randint(1, 25)))
        for a, b in pii.windows(text):
            lat = pii.lattice(text, a, b)
            tokens, starts = [m.group() for m in pii.TOKEN.finditer(text, a, b)], lat.starts
            named, last = [], 99
            for t in tokens:
                solid, sign = not t.isspace(), t in "=:\"'"
                named.append(last <= 2)
                last = 0 if t.lower() in pii.SECRET_WORDS else last + (solid if not sign else 0) + ("\n" in t) + (last == 0 and solid and not sign)
            for j in range(1, len(tokens) + 1):
                want = []
                for i in range(max(0, j - pii.MOST_TOKENS), j):
                    own = tokens[i:j]
                    fits = not own[-1].isspace() and (own[-1][-1].isalnum() or own[-1][-1] in "_-") and not any("\n" in t for t in own)
                    begins = not own[0].isspace() and own[0][0].isascii() and (own[0][0].isalnum() or own[0][0] in "+_.%-(")
                    if fits and begins and any(t == "@" or re.search("[0-9]", t) for t in own) and starts[j] - starts[i] >= 6:
                        want.append((i, plain_features(text[starts[i] : starts[j]], tokens, i, j, named[i]).tolist()))
                assert [(i, f.tolist()) for i, f in lat.segments[j]] == want


@pytest.mark.parametrize("text", ["1000 1001 ", "1_.", "a1@b.c ", "10.2.3.4 "])
def test_long_texts_full_of_candidates(text):
    """Linear in the text: 100 KB, of which 1 MB takes ten times as long."""
    import time

    rng = np.random.default_rng(1)
    began = time.process_time()
    pii.find_spans(text * (100_000 // len(text)), pii.SpanModel(rng.normal(size=(20, 5)), rng.normal(size=4), rng.normal(size=(6, 6))))
    assert time.process_time() - began < 6


def test_an_id_with_very_many_rows_is_one_of_the_sample(spark):
    d = docs(spark, [(1, f"row {i} without anything") for i in range(300)] + [(2, "mail ann@site.example.org and 10.0.0.7 now")])
    learned = pii.train_pii(d, max_docs=2)
    alone = pii.train_pii(d.filter("doc_id = 1"), max_docs=2)
    assert not np.allclose(learned.spans, alone.spans)  # the other id is in the sample, too


def test_decoding_holds_few_columns():
    import tracemalloc

    rng = np.random.default_rng(1)
    k = len(pii.KINDS) + 1
    m = pii.SpanModel(rng.normal(0, 0.3, (pii.N_FEATURES, k - 1)), rng.normal(0, 0.3, 4), rng.normal(0, 0.3, (k, k)))
    text = " ".join(str(1000 + i) for i in range(3000))
    assert pii.windows(text) == [(0, len(text))]
    tracemalloc.start()
    m.decode(text, 0, len(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(text)


def test_detect_and_mask(spark, model):
    rows = [(1, "to a.b@c.org now"), (2, None), (3, ""), (4, "é 10.0.0.1 é"), (4, "é 10.0.0.1 é"), (None, "4539578763621486"), (6, "plain " * 50_000)]
    d = docs(spark, rows)
    got = pii.detect_pii(d, model).collect()
    for r in got:
        want = plain_spans(dict(rows)[r["doc_id"]] or "")
        counts = Counter(k for k, _, _ in want)
        assert [r[f"n_{k}"] for k in pii.BASE] == [counts[k] for k in pii.BASE]
        assert r["base"] == ",".join(f"{k}:{a}:{b}" for k, a, b in want) and set(filter(None, r["base"].split(","))) <= set(r["spans"].split(","))
    masked = sorted((str(r["doc_id"]), r["text"]) for r in pii.mask_pii(d, model).collect() if r["doc_id"] != 6)
    assert masked == [("1", "to [EMAIL] now"), ("2", None), ("3", ""), ("4", "é [IP] é"), ("4", "é [IP] é"), ("None", "[CARD]")]
    assert pii.detect_pii(d.limit(0), model).count() == 0


def test_query_digest(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op9_semi_markov_crf(spark, sf_dir).collect():
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()


# The pipeline.


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "personal_data", "mixing", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        seen[name] = docs = spark.read.parquet(str(tmp_path / name))
    start = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    clean = {r["doc_id"]: r["text"] for r in seen["toxicity"].collect()}
    assert set(clean) <= start and len(clean) > 0.8 * len(start)
    from test_documents import groups_of, sets_of

    want = groups_of(sets_of(list(clean.items()), 5), 80)
    assert {r["doc_id"] for r in seen["near_copies"].collect()} == {i for i in want if want[i] == i}
    for r in seen["personal_data"].collect():
        assert not plain_spans(r["text"]) and r["n_chars"] == len(r["text"])
    copies = Counter(r["doc_id"] for r in seen["mixing"].collect())
    packed = Counter(r["doc_id"] for r in seen["packing"].filter("piece = 0").collect())
    assert copies == packed and set(copies) <= {r["doc_id"] for r in seen["personal_data"].collect()}


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_pipeline_edge_cases(spark, tmp_path):
    """Null ids and texts, repeated rows, a very long text, clashing extra columns; then no rows at all."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (2, long + " more"), (2, long + " more"), (3, None), (3, ""), (None, None), (None, long + " and of nobody else but one who is not here at all" * 3), (None, "x y z"), (None, "x y z"), (7, "mail a.b@c.org " * 20_000), (8, " \n")]
    extra = {c: F.lit("own") for c in ("__id", "__digest", "score", "copy", "shuffle_key", "piece", "shard", "id", "label", "deal")}
    for name, some in (("few", rows), ("none", [])):
        folder = str(tmp_path / name)
        docs(spark, some).withColumns(extra).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        at = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            before, at = at, f(spark, at, folder)
            assert at.columns == before.columns
            at.write.parquet(f"{folder}/{stage}")
            at = spark.read.parquet(f"{folder}/{stage}")
            if stage == "near_copies" and some:
                kept = sorted(((r["doc_id"], r["text"]) for r in at.collect()), key=repr)
                assert kept == sorted([(1, long), (3, None), (3, ""), (None, None), (None, "x y z"), (7, "mail a.b@c.org " * 20_000), (8, " \n"), *[(None, t) for i, t in rows if i is None and t and "nobody" in t]], key=repr)
        packed = corpus_pipeline.STAGES[-1][1](spark, at, folder)
        assert (packed.count() > 0) == bool(some)


def test_clashing_columns(spark, model):
    rows = docs(spark, [(1, "to a.b@c.org now"), (1, "to a.b@c.org now"), (None, None)])
    clash = rows.withColumns({c: F.lit("own") for c in ("id", "n", "key", "base", "spans", "n_email", "score", "h", "x", "y")})
    assert sorted(map(tuple, pii.detect_pii(clash, model).collect()), key=repr) == sorted(map(tuple, pii.detect_pii(rows, model).collect()), key=repr)
    assert set(pii.mask_pii(clash, model).columns) == set(clash.columns)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert {"score", "_score"} <= set(quality.score_quality(clash, quality.train_quality(clash, labels, F.lit(True))).columns)
