"""Cross-tokenizer alignment and fill-in-middle against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from meshvec.llm import alignment, infill, queries

DOCS = "doc_id long, text string, form string, n long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


# Alignment.


@pytest.fixture(scope="module")
def encoders():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.tokenizer_path())
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))


def plain_alignment(text, encoders):
    """(A ids, B ids, groups, links as pairs of places) by comparing all byte ranges; None without tokens."""
    a, b = encoders
    if not text:
        return None
    data = f" {text}".encode()
    shown = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255]
    letters = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    a_ids, b_ids = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
    a_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = []
    for i in b_ids:
        piece = b.id_to_piece(i)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode())
    if b"".join(a_bytes) != data or b"".join(b_bytes) != data:
        return None

    def ranges(tokens):
        at, out = 0, []
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    ra, rb = ranges(a_bytes), ranges(b_bytes)
    links = [(i, j) for i, (s, e) in enumerate(ra) for j, (t, f) in enumerate(rb) if s < f and t < e]
    ends = sorted({e for _, e in ra} & {e for _, e in rb})
    groups, low = [], 0
    for end in ends:
        inside = lambda rs: [k for k, (s, e) in enumerate(rs) if low <= s and e <= end]  # noqa: B023, E731
        groups.append(([a_ids[k] for k in inside(ra)], [b_ids[k] for k in inside(rb)]))
        low = end
    return a_ids, b_ids, groups, links


def plain_rows(rows, encoders):
    found = [(i, plain_alignment(t, encoders)) for i, t in rows]
    counts = Counter((x[0][a], x[1][b]) for _, x in found if x for a, b in x[3])
    tops = {}
    for (_, b), n in counts.items():
        tops[b] = max(tops.get(b, 0), n)
    out = []
    for i, x in found:
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        pairs = [(x[0][a], x[1][b]) for a, b in x[3]]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in x[2])
        out.append((i, len(x[0]), len(x[1]), len(x[2]), len(x[3]), sum(counts[p] == tops[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest()))
    return out


def aligned(spark, rows):
    made = alignment.cross_tokenizer_alignment(docs(spark, rows), queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model"))
    return sorted((tuple(r) for r in made.collect()), key=repr)


def test_alignment_equals_comparison_of_ranges(spark, encoders):
    rng = random.Random(3)
    words = ["the", "Uncle", "naïve", "日本語", "<|endoftext|>", "</s>", "<unk>", "\n", "  ", "don't", "12345", "😀é", " ", "x" * 40, "\x00", "Straße"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 15)))) for i in range(150)]
    rows += [(None, "no id"), (7, "the Uncle"), (7, "the Uncle"), (900, None), (901, ""), (902, " "), (903, "a▁b"), (904, "the " * 200)]
    assert aligned(spark, rows) == sorted(plain_rows(rows, encoders), key=repr)


@pytest.mark.parametrize("share", [1, 50, 10**9])
def test_hot_and_other_pairs_count_alike(spark, encoders, monkeypatch, share):
    monkeypatch.setattr(alignment, "HOT_SHARE", share)
    rows = [(i, f"the cat number {i % 7} sat on the mat") for i in range(60)]
    assert aligned(spark, rows) == sorted(plain_rows(rows, encoders), key=repr)


def test_alignment_of_long_texts(spark):
    rows = [(1, " " * 300_000), (2, "ab" * 300_000), (3, "q1,é" * 100_000)]
    got = {r[0]: r for r in aligned(spark, rows)}
    assert all(got[i][1] > 0 and got[i][4] >= max(got[i][1:3]) and got[i][3] <= min(got[i][1:3]) for i in got)
    assert aligned(spark, []) == []


def test_alignment_query_on_documents(spark, sf_dir, encoders):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r["n_chars"] < 2000]
    assert len(rows) > 50
    assert aligned(spark, rows) == sorted(plain_rows(rows, encoders), key=repr)
    assert queries.op12_interval_alignment(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


# Fill-in-middle.


def plain_infill(i, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digits = hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, None, text, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return i, n, form, p, m, s, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text


def test_infill_equals_plain_python(spark):
    rng = random.Random(1)
    letters = "ab Z1\n\r\u0001\u0002é😀 <PSM>_01\u0085"
    rows = [(i, "".join(rng.choices(letters, k=rng.randint(0, 12)))) for i in range(2000)]
    rows += [(None, "abc d"), (5, None), (7, "a" * 300_000), (8, " \n" * 300_000), (9, "<S<P<M>"), (11, "x\u0002" * 10_000), (12, "same"), (12, "same")]
    got = sorted((tuple(r) for r in infill.fill_in_middle(docs(spark, rows)).collect()), key=repr)
    assert got == sorted((plain_infill(*r) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(docs(spark, [])).count() == 0


def test_infill_stays_in_the_jvm(spark, sf_dir):
    plan = queries.op13_marker_infill(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_overlaps_by_marks():
    """Owners of elementary intervals and the ends of either side, from marks by byte instead of sorted ends."""
    in_a, in_b, a_stops, b_stops, shared = alignment.overlaps(np.array([2, 5, 9]), np.array([1, 5, 6, 9]))
    assert in_a.tolist() == [0, 0, 1, 2, 2] and in_b.tolist() == [0, 1, 1, 2, 3]
    assert a_stops.tolist() == [False, True, True, False, True] and b_stops.tolist() == [True, False, True, True, True]
    assert shared.tolist() == [False, False, True, False, True]
