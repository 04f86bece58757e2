"""Interleaved document sequences: text and media references in reading order, payloads found by digest.

A page's HTML is parsed into an ordered list of items. A text item holds a run of text; a media
item holds the reference, the digest if the reference names one, the alternative text and the
caption of its figure. Positions count items from 0, so they stay aligned when payloads are resolved
later: a resolution joins on the digest and never reorders, drops or adds items. Payloads live in a
media table in the shared folder, in a container with a short header and 8-bit samples (PGM: width
24, 24 rows for each 576 bytes). A task stores a digest once, however many of its rows have that
payload; what is known of a payload is computed from the stored bytes, read back, and reduced to one
row for each digest before references meet it.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import documents, table, written

SIDE = 24
TILE = SIDE * SIDE
REFERENCE = "sha256:"
ITEM = "array<struct<pos:int,kind:string,text:string,src:string,digest:string,alt:string,caption:string>>"
SEEN = 100_000  # digests that a task remembers to have stored; beyond that it starts anew
_BREAKS = set("p div h1 h2 h3 h4 h5 h6 li ul ol br tr td th table article section figure header footer blockquote pre".split())
_HIDDEN = {"script", "style", "template", "noscript"}
_MEDIA = {"img", "audio", "video", "source", "embed"}


class _Sequence(HTMLParser):
    """Collects items. A caption ends at its end tag, at that of its figure or at the end of the page,
    and belongs to the media items of its figure, before it or after it; outside figures it is text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figures: list[dict] = []  # open ones: first item, captions
        self.hidden = ""

    def _end_text(self):
        run = " ".join("".join(self.text).split())
        self.text = []
        if run:
            self.items.append({"kind": "text", "text": run})

    def _end_caption(self):
        if self.caption is not None:
            self.figures[-1]["said"].append(" ".join("".join(self.caption).split()))
            self.caption = None

    def _end_figure(self):
        self._end_caption()
        self._end_text()
        figure = self.figures.pop()
        said = " ".join(x for x in figure["said"] if x)
        held = [x for x in self.items[figure["first"] :] if x["kind"] == "media" and "caption" not in x]
        if figure["said"]:
            for item in held:
                item["caption"] = said
            if not held and said:  # a figure without media: its caption is text
                self.items.append({"kind": "text", "text": said})

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            return
        if tag in _HIDDEN:
            self.hidden = tag
        elif tag in _MEDIA:
            src = next((v for k, v in attrs if k == "src" and v), "")
            if src:
                self._end_text()
                digest = src[len(REFERENCE) :].lower() if src.startswith(REFERENCE) else None
                self.items.append({"kind": "media", "src": src, "digest": digest, "alt": dict(attrs).get("alt")})
        elif tag == "figcaption":
            self._end_text()
            if self.figures:
                self._end_caption()
                self.caption = []
        elif tag == "figure":
            self._end_caption() if self.figures else None
            self._end_text()
            self.figures.append({"first": len(self.items), "said": []})
        elif tag in _BREAKS:
            if self.caption is not None:
                self.caption.append(" ")
            self._end_text()

    def handle_startendtag(self, tag, attrs):
        if tag not in _HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == self.hidden:
            self.hidden = ""
        elif self.hidden:
            return
        elif tag == "figcaption":
            self._end_text()
            if self.figures:
                self._end_caption()
        elif tag == "figure":
            if self.figures:
                self._end_figure()
        elif tag in _BREAKS:
            if self.caption is not None:
                self.caption.append(" ")
            self._end_text()

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)

    def finish(self) -> list[dict]:
        self.close()
        while self.figures:
            self._end_figure()
        self._end_text()
        return self.items


def parse(page: str | None) -> list[dict]:
    """Items of one page: null or empty HTML has none; markup that never ends is closed at the end."""
    p = _Sequence()
    p.feed(page or "")
    return [{"pos": i, **{k: x.get(k) for k in ("kind", "text", "src", "digest", "alt", "caption")}} for i, x in enumerate(p.finish())]


def sequences(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """key and items, the ordered text and media-reference structs; one row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pos", pa.int32()), *((c, pa.string()) for c in ("kind", "text", "src", "digest", "alt", "caption"))]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parse(x.as_py()) for x in b.column(1)], kind)], [key, "items"])

    return pages.select(F.col(key).cast("long").alias(key), F.col(column).cast("string").alias(column)).mapInArrow(run, f"{key} long, items {ITEM}")


def pack(payload: bytes) -> bytes:
    """The stored form of a payload whose length is a multiple of TILE."""
    return b"P5\n%d %d\n255\n" % (SIDE, len(payload) // SIDE) + payload


def unpack(stored: bytes) -> bytes:
    """The payload, read by what the header says."""
    kind, shape, top, samples = stored.split(b"\n", 3)
    width, height = map(int, shape.split())
    if kind != b"P5" or top != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit PGM of the size that its header names")
    return samples


def pad(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % TILE or (0 if raw else TILE))


def describe(payload: bytes) -> str:
    """A fingerprint of the samples: mean, deviation, share of edges, and a histogram over 16 levels."""
    x = np.frombuffer(payload, np.uint8)
    n = np.bincount(x, minlength=256)
    level = np.arange(256)
    mean = float(n @ level) / len(x)
    dev = max(0.0, float(n @ (level * level)) / len(x) - mean * mean) ** 0.5
    edges = int(np.count_nonzero(x[1:] != x[:-1]))
    return f"{len(x) // SIDE}x{SIDE};mean={mean:.4f};dev={dev:.4f};edges={edges};hist=" + ",".join(map(str, n.reshape(16, 16).sum(1)))


FACTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _facts(n_bytes: int, stored: bytes) -> tuple:
    payload = unpack(stored)
    return n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(payload)


def store(payloads: DataFrame) -> DataFrame:
    """digest, n_bytes and media (the stored form) from rows of (digest, n_bytes, payload), as a table in the shared folder.

    A task stores a digest once (as long as it remembers it); tasks don't wait for one another, so
    the table may have a digest as often as there are tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                new = []
                for k, digest in enumerate(part.column("digest").to_pylist()):
                    key = bytes.fromhex(digest)
                    if key not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        new.append(k)
                if new:
                    part = part.take(pa.array(new))
                    media = pa.array([pack(x.as_py()) for x in part.column("payload")], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column("digest"), part.column("n_bytes"), media], ["digest", "n_bytes", "media"])

    rows = payloads.select("digest", "n_bytes", "payload").mapInArrow(run, "digest string, n_bytes long, media binary")
    return written(rows, compression="zstd")


def facts(media: DataFrame) -> DataFrame:
    """digest and facts of each stored payload (digest, n_bytes, media); one row for each digest."""
    schema = pa.schema([("digest", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                rows = [(d.as_py(), *_facts(n.as_py(), m.as_py())) for d, n, m in zip(*(part.column(c) for c in ("digest", "n_bytes", "media")))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    out = media.select("digest", "n_bytes", "media").mapInArrow(run, f"digest string, {FACTS}")
    return out.groupBy("digest").agg(*(F.first(c).alias(c) for c in schema.names[1:]))


def resolve(refs: DataFrame, media: DataFrame) -> DataFrame:
    """refs (any columns and digest) with media's other columns; refs without media keep nulls.

    media is reduced to one row for each digest and written, so that the join reads two plain
    tables and adaptive execution can split a digest that a third of all references name. Select
    only what is needed from media beforehand: other columns, payloads too, then never move.
    """
    one = media.groupBy("digest").agg(*(F.first(c).alias(c) for c in media.columns if c != "digest"))
    return refs.join(written(one), "digest", "left")


def document_payloads(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload (the text's UTF-8 bytes, padded with 255 to a positive multiple of TILE) and its digest."""
    raw = F.col("text").cast("binary")
    short = F.pmod(-F.octet_length("text"), F.lit(TILE)) + F.when(F.octet_length("text") == 0, TILE).otherwise(0)
    out = documents(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.concat(raw, F.unhex(F.repeat(F.lit("FF"), short))).alias("payload"))
    return out.withColumn("digest", F.sha2("payload", 256))


def figure_pages(payloads: DataFrame) -> DataFrame:
    """doc_id and html: a page that names each document's payload once, with a caption."""
    html = F.concat(F.lit(f'<article><p>Document</p><figure><img src="{REFERENCE}'), F.col("digest"), F.lit('" alt="bytes of a text"><figcaption>'), F.col("n_bytes"), F.lit(" bytes</figcaption></figure></article>"))
    return payloads.select("doc_id", html.alias("html"))


def document_media(docs: DataFrame) -> DataFrame:
    """doc_id and the facts of its stored payload, found through the page's media reference.

    One row for each input row; null texts are empty ones, whose payload is one tile of 255. Equal
    texts have one media row and so equal values. Payloads are written where they are and read back
    where they lie: only references and facts move between tasks.
    """
    payloads = document_payloads(docs)
    items = sequences(figure_pages(payloads), "doc_id").select("doc_id", F.explode("items").alias("item")).where("item.kind = 'media'")
    refs = items.select("doc_id", F.col("item.digest").alias("digest"), F.col("item.pos").alias("pos"), F.col("item.caption").alias("caption"))
    return resolve(refs, facts(store(payloads))).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(table(spark, sf_dir, "documents"))
