"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
Span = tuple[str, int, int]

AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    double = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return (sum(map(int, digits[-1::-2])) + sum(double[int(c)] for c in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ with a domain, the run of local characters before it; runs don't overlap, so the work is linear."""
    done = at = 0
    while m := AT_DOMAIN.search(text, at):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = at = m.end()
        else:
            at = m.start() + 1


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Chains of numbers joined by dots, four at a time from the left."""
    for m in NUMBERS.finditer(text):
        if m.group().count(".") >= 3:
            parts, at = m.group().split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                end = at + sum(map(len, parts[i : i + 4])) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                    yield at, end
                at = end + 1


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; those that fail its test are dropped."""
    found: list[Span] = []
    if "@" in text:
        found += [("email", a, b) for a, b in emails(text)]
    if NUMBERS.search(text):
        found += [("ip", a, b) for a, b in ips(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return found


# The conditional random field.

TOKEN = re.compile(r"[A-Za-z0-9_]+|[^\W_]+|\s+|.", re.DOTALL)
#: @, and each run of letters and digits that has a digit: a candidate segment needs one of them.
TRIGGER = re.compile(r"@|(?<![A-Za-z0-9_])[A-Za-z_]*+[0-9][A-Za-z0-9_]*")
HAS_DIGIT = re.compile(r"[0-9]")
#: Words before a value that name it as a secret.
SECRET_WORDS = frozenset(("password", "passwd", "pwd", "pass", "token", "secret", "key", "apikey", "api_key", "access_key", "auth", "bearer", "credential"))
#: A labelling rule for training only: a named value with both letters and digits.
SECRET_RULE = re.compile(r"(?i)\b(?:password|passwd|pwd|token|secret|api_?key|access_key)[ ]?[=:][ ]?[\"']?([A-Za-z0-9_]{8,})")
#: Tokens that an entity may have, and characters around a trigger that a window takes in.
MOST_TOKENS, AROUND = 14, 48
N_FEATURES = 20
#: Documents and windows to learn from, at most, and the characters that such a window may have. Windows of any length are decoded.
MAX_TRAIN_DOCS, MAX_TRAIN_WINDOWS, MAX_TRAIN_CHARS = 4000, 500, 400


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around every @ and every run with a digit; the rest of the text has no candidate segment."""
    found: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if found and a <= found[-1][1]:
            found[-1] = (found[-1][0], b)
        else:
            found.append((a, b))
    return found


@dataclass
class Lattice:
    """The tokens of a window and its candidate segments: (first token, end token, features), by end token."""

    starts: list[int]
    outside: np.ndarray
    segments: list[list[tuple[int, np.ndarray]]]


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


#: Bits of the features that are there or not; features 7 and 8 are numbers.
ALWAYS, MAIL, ADDRESS, CARD_NUMBER, PHONE_NUMBER, PHONE_11, CARD_16 = (1 << i for i in range(7))
MIXED, DENSE, NAMED, NAMED_MIXED, BEFORE_OPENS, AFTER_CLOSES, BEFORE_JOINS, AFTER_JOINS, SINGLE, SPACED, TOUCHING = (1 << i for i in range(9, 20))
WORD_ONLY = re.compile(r"[A-Za-z0-9_]+")


@dataclass(slots=True)
class Held:
    """A token and what candidate segments ask of it, found once: digits, dots, whether it may begin one or tells, and what its end is to a segment behind it."""

    text: str
    start: int
    named: bool
    begins: bool
    tells: bool
    digits: int
    dots: int
    space: bool
    line: bool
    beside: int


def _behind(t: str) -> int:
    """The features that a token gives to a segment that begins right after it."""
    end = t[-1]
    return (BEFORE_OPENS if end.isspace() or t in "\"'=:(<[,;" else 0) | (BEFORE_JOINS if end in "._%+-@" else 0) | (TOUCHING if end.isalnum() else 0)


def _ahead(t: str) -> int:
    """The features that a token gives to a segment that ends right before it."""
    first = t[0]
    return (AFTER_CLOSES if first.isspace() or t in "\"'),.;>]" else 0) | (AFTER_JOINS if first in "._-@" else 0) | (TOUCHING if first.isalnum() else 0)


def _shape(s: str, digits: int, dots: int, at: bool, single: bool) -> int:
    """The features of a segment's own text, patterns being asked only where counts leave room for them."""
    bits, n = 0, len(s)
    if at and (mail := AT_DOMAIN.search(s)) and mail.end() == n and mail.start() > 0 and all(c in LOCAL for c in s[: mail.start()]):
        bits |= MAIL
    if dots == 3 and digits == n - 3 and list(ips(s)) == [(0, n)]:
        bits |= ADDRESS
    if 13 <= digits <= 19 and CARD.fullmatch(s) and luhn(_digits(s)):
        bits |= CARD_NUMBER | (CARD_16 if digits == 16 else 0)
    if 9 <= digits <= 15 and s[0] == "+" and PHONE.fullmatch(s):
        bits |= PHONE_NUMBER | (PHONE_11 if digits == 11 else 0)
    if single and n >= 8 and 0 < digits < n and WORD_ONLY.fullmatch(s):
        bits |= MIXED | (DENSE if _entropy(s) > 2.5 else 0)
    return bits


#: A candidate segment: first token, bits, share of MOST_TOKENS, share of digits.
Segment = tuple[int, int, float, float]


def columns(text: str, a: int, b: int) -> Iterator[tuple[int, tuple[bool, ...], list[Segment]]]:
    """For each token of a window: its end, its outside features, and the candidate segments that end with it.

    Only the last MOST_TOKENS tokens and the two beside them are held. Counts
    grow as a segment is drawn back token by token, so a candidate costs the
    same however long it is, but for the patterns that its counts leave room for.
    """
    held: deque[Held] = deque(maxlen=MOST_TOKENS + 2)
    last, n = 99, 0

    def ending(after: str) -> list[Segment]:
        found: list[Segment] = []
        u = held[-1]
        if u.space or not (u.text[-1].isalnum() or u.text[-1] in "_-"):
            return found
        telling = at = spaced = False
        m, digits, dots, end, ahead = len(held), 0, 0, u.start + len(u.text), _ahead(after)
        for back in range(1, min(m, MOST_TOKENS) + 1):
            h = held[m - back]
            if h.line:
                break
            digits, dots = digits + h.digits, dots + h.dots
            telling, at, spaced = telling or h.tells, at or h.text == "@", spaced or h.space
            if telling and h.begins and end - h.start >= 6:
                s = text[h.start : end]
                bits = ALWAYS | ahead | (held[m - back - 1].beside if back < m else BEFORE_OPENS) | _shape(s, digits, dots, at, back == 1)
                if h.named:
                    bits |= NAMED | (NAMED_MIXED if bits & MIXED else 0)
                bits |= (SINGLE if back == 1 else 0) | (SPACED if spaced else 0)
                found.append((n - back, bits, back / MOST_TOKENS, digits / len(s)))
        return found[::-1]

    def column(after: str) -> tuple[int, tuple[bool, ...], list[Segment]]:
        h = held[-1]
        return h.start + len(h.text), (True, not h.space, h.text == "@", h.tells and h.text != "@"), ending(after)

    for match in TOKEN.finditer(text, a, b):
        t = match.group()
        if held:
            yield column(t)
        space, sign = t.isspace(), t in "=:\"'"
        digits = len(_digits(t))
        # named: a word for a secret stands just before the token, but for a sign or quote
        begins = not space and t[0].isascii() and (t[0].isalnum() or t[0] in "+_.%-(")
        held.append(Held(t, match.start(), last <= 2, begins, t == "@" or digits > 0, digits, t == ".", space, "\n" in t, _behind(t)))
        solid = not space
        last = 0 if t.lower() in SECRET_WORDS else last + (solid if not sign else 0) + ("\n" in t) + (last == 0 and solid and not sign)
        n += 1
    if held:
        yield column(" ")


def vector(segment: Segment) -> np.ndarray:
    """The features of a candidate segment as numbers."""
    _, bits, share, digits = segment
    f = np.array([bits >> i & 1 for i in range(N_FEATURES)], float)
    f[7], f[8] = share, digits
    return f


def lattice(text: str, a: int, b: int) -> Lattice:
    """All columns of a window at once, for learning."""
    starts, outside, segments = [a], [], [[]]
    for end, out, ending in columns(text, a, b):
        starts.append(end)
        outside.append(out)
        segments.append([(x[0], vector(x)) for x in ending])
    return Lattice(starts, np.array(outside, float).reshape(-1, 4), segments)


@dataclass
class SpanModel:
    """Weights of span features by kind, of outside tokens, and of one kind after another (0: outside)."""

    spans: np.ndarray
    outside: np.ndarray
    after: np.ndarray

    def decode(self, text: str, a: int, b: int) -> list[Span]:
        """The best segmentation of a window: for each token that could end a segment, over all kinds and starts within the bound.

        Scores of the last MOST_TOKENS + 1 places are held; of the others only
        two bytes a kind (how far back, from which kind) and the place's offset.
        """
        k, ring = len(KINDS) + 1, MOST_TOKENS + 1
        after, weights = self.after.tolist(), self.spans.tolist()
        by_share, by_digits, kinds = weights[7], weights[8], range(1, k)
        told: dict[int, list[float]] = {}  # the scores of segments' bits, by kind
        plain: dict[tuple[bool, ...], float] = {}  # those of outside tokens
        far, kind_before, starts = array("B", bytes(k)), array("B", bytes(k)), array("q", [a])

        def entered(scores: list[float]) -> list[tuple[float, int]]:
            """For each kind the best score with which a segment of it begins here, and the kind before."""
            open_ = [y for y in range(k) if scores[y] > -math.inf]
            if len(open_) == 1:
                y = open_[0]
                return [(scores[y] + x, y) for x in after[y]]
            found = []
            for c in range(k):
                top, at = -math.inf, 0
                for y in open_:
                    if (score := scores[y] + after[y][c]) > top:
                        top, at = score, y
                found.append((top, at))
            return found

        nothing = [-math.inf] * (k - 1)
        enter = [entered([0.0, *nothing])] * ring
        n = 0
        for end, out, ending in columns(text, a, b):
            n += 1
            score, y = enter[(n - 1) % ring][0]
            if out not in plain:
                plain[out] = float(np.dot(out, self.outside))
            best, far_here, before_here = [score + plain[out], *nothing], [1] + [0] * (k - 1), [y] + [0] * (k - 1)
            for i, bits, share, digits in ending:
                own = told.get(bits)
                if own is None:
                    own = told[bits] = [sum(weights[f][c] for f in range(N_FEATURES) if bits >> f & 1) for c in range(k - 1)]
                begun = enter[i % ring]
                for c in kinds:
                    score, y = begun[c]
                    score += own[c - 1] + share * by_share[c - 1] + digits * by_digits[c - 1]
                    if score > best[c]:
                        best[c], far_here[c], before_here[c] = score, n - i, y
            enter[n % ring] = entered(best)
            far.extend(far_here)
            kind_before.extend(before_here)
            starts.append(end)
        found, j, y = [], n, best.index(max(best))
        while j > 0:
            i = j - far[j * k + y]
            if y:
                found.append((KINDS[y - 1], starts[i], starts[j]))
            j, y = i, kind_before[j * k + y]
        return found[::-1]


def _lse(x: np.ndarray, axis: int = 0) -> np.ndarray:
    m = np.max(x, axis=axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0)
    with np.errstate(divide="ignore"):
        return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def gradient(model: SpanModel, lat: Lattice, gold: list[Span]) -> tuple[float, SpanModel]:
    """Log-likelihood of the gold segmentation and its gradient, by the forward and backward sums over all segmentations."""
    n, k = len(lat.outside), len(KINDS) + 1
    out = lat.outside @ model.outside
    scores = [[f @ model.spans for _, f in segs] for segs in lat.segments]
    fwd = np.full((n + 1, k), -np.inf)
    fwd[0, 0] = 0
    for j in range(1, n + 1):
        fwd[j, 0] = _lse(fwd[j - 1] + model.after[:, 0]) + out[j - 1]
        for (i, _), s in zip(lat.segments[j], scores[j], strict=True):
            fwd[j, 1:] = np.logaddexp(fwd[j, 1:], _lse(fwd[i][:, None] + model.after[:, 1:]) + s)
    bwd = np.full((n + 1, k), -np.inf)
    bwd[n] = 0
    total = _lse(fwd[n])
    g = SpanModel(np.zeros_like(model.spans), np.zeros_like(model.outside), np.zeros_like(model.after))
    for j in range(n, 0, -1):
        for (i, f), s in zip(lat.segments[j], scores[j], strict=True):
            arc = model.after[:, 1:] + (s + bwd[j, 1:])[None, :]
            bwd[i] = np.logaddexp(bwd[i], _lse(arc, 1))
            p = np.exp(fwd[i][:, None] + arc - total)
            g.after[:, 1:] -= p
            g.spans -= np.outer(f, p.sum(0))
        arc = model.after[:, 0] + out[j - 1] + bwd[j, 0]
        bwd[j - 1] = np.logaddexp(bwd[j - 1], arc)
        p = np.exp(fwd[j - 1] + arc - total)
        g.after[:, 0] -= p
        g.outside -= lat.outside[j - 1] * p.sum()
    at = {p: i for i, p in enumerate(lat.starts)}
    ends = {at[a]: (at[b], KINDS.index(kind)) for kind, a, b in gold}
    j, y, like = 0, 0, -float(total)
    while j < n:
        if j in ends:
            end, kind = ends[j]
            f = next(f for i, f in lat.segments[end] if i == j)
            like += model.after[y, kind + 1] + f @ model.spans[:, kind]
            g.after[y, kind + 1] += 1
            g.spans[:, kind] += f
            j, y = end, kind + 1
        else:
            like += model.after[y, 0] + out[j]
            g.after[y, 0] += 1
            g.outside += lat.outside[j]
            j, y = j + 1, 0
    return like, g


def training_window(text: str, a: int, b: int, spans: list[Span]) -> tuple[Lattice, list[Span]] | None:
    """A window with those labelled spans that are candidate segments of it; None if one isn't."""
    lat = lattice(text, a, b)
    at = {p: i for i, p in enumerate(lat.starts)}
    gold, end = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if e <= a or s >= b or s < end:
            continue
        if s not in at or e not in at or all(i != at[s] for i, _ in lat.segments[at[e]]):
            return None
        gold.append((kind, s, e))
        end = e
    return lat, gold


def fit(examples: list[tuple[Lattice, list[Span]]], *, epochs: int = 6, rate: float = 0.2, l2: float = 1e-3) -> SpanModel:
    """Adagrad on the log-likelihood, in the given order."""
    k = len(KINDS) + 1
    model = SpanModel(np.zeros((N_FEATURES, k - 1)), np.zeros(4), np.zeros((k, k)))
    names = ("spans", "outside", "after")
    seen = {n: np.full_like(getattr(model, n), 1e-2) for n in names}
    for _ in range(epochs):
        for lat, gold in examples:
            _, g = gradient(model, lat, gold)
            for n in names:
                w, step = getattr(model, n), getattr(g, n)
                step = step - l2 * w
                seen[n] += step**2
                w += rate * step / np.sqrt(seen[n])
    return model


#: Entities that a sample without labels can't show: lines with the spans that the base patterns and the rule don't give. Their windows always take part.
SEED_LINES = (
    ("please write to ann.lee@mail.example.com or call +1 (212) 555-0143 today", ()),
    ("the host 10.24.7.201 was paid with 4539578763621486 and then left", ()),
    ('set password=q8r7t6y5u4i3o2p1 and token = "9f8e7d6c5b4a39281706f5e4d3c2b1a0ffeeddcc" now', ()),
    ("in 2024 about 123456 people read version 3.11.4 of chapter 99871234", ()),
    ("call +1 (415) 555-0199 4024007198964305 is the card of bob.ray@site.example.org", (("phone", 5, 22), ("card", 23, 39))),
    ("order 20231105998877 shipped to room 1200 on line 445566778899", ()),
    ("the login password=a7b2k9d4 is old and token: Qw4rT8yU1pL is new", ()),
    ('with api_key = "m3n8b5v2c7x1" and secret: z9y8w7v6u5 in the file', ()),
    ("model abc12de4 of part x9k2m7 and file draft_v2b came in box 12 on day 7", ()),
)


def train_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_TRAIN_DOCS, max_windows: int = MAX_TRAIN_WINDOWS, max_chars: int = MAX_TRAIN_CHARS) -> SpanModel:
    """Learn from a bounded sample: windows of at most max_docs documents (the smallest hashes of ids), labelled by the base patterns and the rule for secrets.

    Each document sends its first window with a label and its first without,
    of those that have at most max_chars characters; the driver keeps
    max_windows. Longer windows teach nothing, and are decoded like others.
    """

    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            text = text or ""
            spans, kept = base_spans(text), {}
            spans += [("secret", *m.span(1)) for m in SECRET_RULE.finditer(text) if 0 < len(_digits(m.group(1))) < len(m.group(1))]
            for a, b in windows(text):
                if b - a <= max_chars:
                    kept.setdefault(any(a <= s and e <= b for _, s, e in spans), text[a:b])
            out.append(list(kept.values()))
        return pd.Series(out)

    ids = docs.select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(max_docs)
    # at most max_docs ids are broadcast
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    got = sample.select("id", F.explode(F.pandas_udf(cut, "array<string>")("text")).alias("w")).orderBy(F.xxhash64("id", "w")).limit(max_windows).collect()
    examples = []
    for text, more in [*SEED_LINES * 4, *((r["w"], ()) for r in sorted(got, key=lambda r: (str(r["id"]), r["w"])))]:
        spans = base_spans(text) + [("secret", *m.span(1)) for m in SECRET_RULE.finditer(text) if 0 < len(_digits(m.group(1))) < len(m.group(1))] + list(more)
        if found := training_window(text, 0, len(text), spans):
            examples.append(found)
    return fit(examples)


def find_spans(text: str, model: SpanModel) -> tuple[list[Span], list[Span]]:
    """The base spans, and those the model adds where no base span is."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    added, i = [], 0
    for a, b in windows(text):
        for kind, s, e in model.decode(text, a, b):
            while i < len(taken) and taken[i][1] <= s:
                i += 1
            # those before i end before s; if the one at i begins at e or later, so do all after it
            if i == len(taken) or taken[i][0] >= e:
                added.append((kind, s, e))
    return base, added


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def detect_pii(docs: DataFrame, model: SpanModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the number of base spans by kind, all base spans and all spans as text.

    Defined cases: null and empty texts have no spans; repeated rows have a
    result each; null ids stay null; an empty table gives an empty result;
    further columns are not used.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, added = find_spans(text or "", model)
                counts = Counter(k for k, _, _ in base)
                rows.append((*(counts[k] for k in BASE), joined(base), joined(base + added)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(c, pa.string()) for c in cols[4:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *(f"n_{k}" for k in BASE), "base", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def mask_text(text: str, spans: list[Span]) -> str:
    """Each span, or run of overlapping spans, becomes the name of its first kind in brackets."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, model: SpanModel, *, text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; null stays null, texts without spans stay as they are."""

    def mask(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            base, added = find_spans(text, model)
            return mask_text(text, base + added) if base or added else text

        return texts.map(one)

    return docs.withColumn(text_col, F.pandas_udf(mask, "string")(F.col(text_col)))
