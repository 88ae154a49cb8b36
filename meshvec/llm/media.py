"""Media columns: interleaved sequences of texts and media, resolved by digest."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshvec.llm.common import cut
from meshvec.llm.markup import BLOCK, Node, parse

#: A tile is 24 x 24 samples; a payload is one or more tiles, one below the other.
SIDE, TILE = 24, 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEMS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
REFERENCE = "media:"


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % TILE if data else TILE)


def encode_png(payload: bytes) -> bytes:
    """An 8-bit grey PNG of SIDE samples a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    raw = np.zeros((len(rows), SIDE + 1), np.uint8)  # filter type 0 before each row
    raw[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", SIDE, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 3)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of a PNG that encode_png made; a damaged one raises ValueError."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, size = 8, b"", None
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image")
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(size[1], size[0] + 1)
    if raw[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return raw[:, 1:].tobytes()


def image_feature(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit hash of which of 64 equal stretches are lighter than their mean."""
    x = np.frombuffer(samples, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    edges = np.linspace(0, len(x), 65).astype(np.int64)
    sums = np.add.reduceat(x.astype(np.int64), edges[:-1]) / np.diff(edges)
    bits = int("".join("1" if b else "0" for b in sums > sums.mean()), 2)
    return f"{x.mean():.4f};{x.std():.4f};{-(p * np.log2(p)).sum():.4f};{bits:016x}"


def items_of(html: str | None) -> list[tuple[int, str, str | None, str | None, str | None]]:
    """The texts and media references of a page in order: (position, kind, text, digest, caption).

    A caption is the figcaption of the figure around a reference, or else its
    alt text. References that don't name a digest get the SHA-256 of their address.
    """
    out: list[list] = []
    buffer: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(buffer).split()):
            out.append([len(out), "text", text, None, None])
        buffer.clear()

    def text_of(x: Node) -> str:
        parts, todo = [], [x]
        while todo:
            y = todo.pop()
            if isinstance(y, str):
                parts.append(y)
            else:
                todo += reversed(y.children)
        return " ".join("".join(parts).split())

    def caption_for(x: Node) -> str | None:
        y = x.parent
        while y is not None and y.tag != "figure":
            y = y.parent
        if y is not None:
            for c in y.children:
                if isinstance(c, Node) and c.tag == "figcaption":
                    return text_of(c)
        return x.attributes().get("alt")

    root = parse(html or "")
    stack = [(root, iter(root.children))]
    while stack:
        node, rest = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            if node.tag in BLOCK:
                flush()
            continue
        if isinstance(child, str):
            buffer.append(child)
            continue
        if child.tag == "figcaption" and node.tag == "figure":
            continue
        if child.tag in ("img", "video", "audio", "source") and (src := child.attributes().get("src")):
            flush()
            digest = src.removeprefix(REFERENCE) if src.startswith(REFERENCE) else hashlib.sha256(src.encode()).hexdigest()
            out.append([len(out), "media", None, digest, caption_for(child)])
        elif child.tag in BLOCK:
            flush()
        stack.append((child, iter(child.children)))
    flush()
    return [tuple(x) for x in out]


def parse_sequences(pages: DataFrame, *, id_col: str, html_col: str) -> DataFrame:
    """id, items: the ordered structs of each page."""
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
    names = [f.name for f in kind.value_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(names, x, strict=True)) for x in items_of(h)] for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["id", "items"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"id long, items {ITEMS}")


def store_payloads(items: DataFrame, *, data_col: str) -> DataFrame:
    """digest, media: the stored form of each distinct value, addressed by the SHA-256 of the value's bytes. Repeats are dropped, by an aggregate combined before its shuffle, before anything is encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                media = [encode_png(padded(x or b"")) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], ["digest", "media"])

    data = F.coalesce(F.col(data_col), F.lit("")).cast("binary")
    return items.select(F.sha2(data, 256).alias("digest"), data.alias("data")).dropDuplicates(["digest"]).mapInArrow(run, "digest string, media binary")


READ_BACK = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_payloads(media: DataFrame) -> DataFrame:
    """Read every stored form back: its checks and feature by digest. No UTF-8 text ends in byte 255, so the padding shows."""
    names = [c.split()[0] for c in READ_BACK.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in READ_BACK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = decode_png(stored)
                rows.append((digest, len(x.rstrip(b"\xff")), len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), image_feature(x)))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return media.select("digest", "media").mapInArrow(run, READ_BACK)


def resolve(items: DataFrame, payloads: DataFrame) -> DataFrame:
    """Items as rows (id, position, kind, text, digest, caption, ...) with the payload columns of their digest, null for texts and for unknown digests.

    payloads is a stored table (a checkpoint will do), so both sides of the
    join are plain shuffles by digest, and Spark's adaptive skew join splits
    the references of a digest that many documents share over several tasks.
    Texts have no digest, so those that shouldn't be shuffled with the
    references are left out before.
    """
    return items.join(payloads, "digest", "left")


def item_rows(sequences: DataFrame, kind: str | None = None) -> DataFrame:
    """id, n_items, position, kind, text, digest, caption: the items of sequences, or those of one kind, at their places."""
    wanted = F.col("items") if kind is None else F.filter("items", lambda x: x["kind"] == kind)
    return sequences.select("id", F.size("items").alias("n_items"), F.explode(wanted).alias("item")).select("id", "n_items", "item.*")


def document_html(text: Column, id_col: Column) -> Column:
    """A document as a page: its lines as paragraphs, then its picture, named by digest, with the id as its caption."""
    text = F.coalesce(text, F.lit(""))
    safe = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lines = F.concat(F.lit("<p>"), F.replace(safe, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    return F.concat(lines, F.lit('<figure><img src="'), F.lit(REFERENCE), F.sha2(text.cast("binary"), 256), F.lit('"><figcaption>'), F.coalesce(id_col.cast("string"), F.lit("")), F.lit("</figcaption></figure>"))


def document_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document as a sequence of its text blocks and, after them, its text stored as a picture, whose samples are read back.

    The page is parsed into the sequence, its reference resolved by digest;
    position (from 0) is the picture's place among the n_items of its
    document. Equal texts are stored and read once. Defined cases: a null text
    is empty and fills one tile, and its picture is the only item; a null id
    stays null; repeated rows have a result each; an empty table gives an empty
    result; further columns are not used.
    """
    pages = docs.select(F.col(id_col).cast("long").alias("id"), document_html(F.col(text_col), F.col(id_col)).alias("html"))
    pictures = item_rows(parse_sequences(pages, id_col="id", html_col="html"), "media")
    found = resolve(pictures, cut(read_payloads(store_payloads(docs, data_col=text_col))))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "n_items", "caption")
