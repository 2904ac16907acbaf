"""Media columns: interleaved document sequences of ordered text and media references.

HTML is parsed into one ordered list of struct(position, kind, text, digest, caption): runs of text and media
references, in document order. Payloads live once per digest in a media table of binary pixmaps (P6: 8-bit RGB
samples, 64 pixels = 192 bytes a row). A join by digest resolves the references; position and caption travel
with the reference, so they stay aligned. Only descriptors take part in the join, never the payloads.

Defined cases: null html or text is empty; a reference without a stored payload resolves to null fields; equal
payloads are stored once per task and described once; repeated rows and extra columns are kept; a long text is one
tall pixmap; there are no ties; an empty table gives empty results of the same columns.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm._common import column, staged, text_bytes

ROW = 192  # bytes of a row of 64 RGB pixels
PART = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
MEDIA_TAGS = {"img": "image", "audio": "audio", "video": "video"}
_SKIPPED = {"script", "style"}


class _Sequence(HTMLParser):
    """Collects text runs and media references in order; a figure's caption belongs to its references."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.figure: list[dict] | None = None
        self.caption: list[str] | None = None
        self.skipping = 0

    def _add(self, kind: str, text: str | None, digest: str | None, caption: str | None) -> dict:
        self.parts.append(part := {"position": len(self.parts), "kind": kind, "text": text, "digest": digest, "caption": caption})
        return part

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        if tag in _SKIPPED:
            self.skipping += 1
        elif tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in MEDIA_TAGS and given.get("src"):
            src = given["src"]
            digest = src.removeprefix("sha256:") if src.startswith("sha256:") else hashlib.sha256(src.encode()).hexdigest()
            part = self._add(MEDIA_TAGS[tag], None, digest, given.get("alt"))
            if self.figure is not None:
                self.figure.append(part)

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIPPED:
            self.skipping = max(0, self.skipping - 1)
        elif tag == "figcaption" and self.caption is not None:
            for part in self.figure or ():
                part["caption"] = " ".join("".join(self.caption).split())
            self.caption = None
        elif tag == "figure":
            self.figure = None

    def handle_data(self, data: str) -> None:
        if self.skipping:
            return
        if self.caption is not None:
            self.caption.append(data)
        elif words := " ".join(data.split()):
            if self.parts and self.parts[-1]["kind"] == "text":
                self.parts[-1]["text"] += " " + words
            else:
                self._add("text", words, None, None)


def parse_html(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    return parser.parts


def sequences(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, parts) for each row: the interleaved sequence of its html."""
    schema = f"`{key}` {pages.schema[key].dataType.simpleString()}, parts array<{PART}>"
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = pa.array([parse_html(x) for x in column(b, html).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([column(b, key), parts], [key, "parts"])

    return pages.select(key, html).mapInArrow(parse, schema)


def encode_pixmap(payload: bytes) -> bytes:
    """A P6 pixmap whose samples are the payload, a positive multiple of 192 bytes."""
    return b"P6\n64 %d\n255\n" % (len(payload) // ROW) + payload


_HEADER = re.compile(rb"P6\s+(\d+)\s+(\d+)\s+(\d+)\s")


def decode_pixmap(media: bytes) -> tuple[int, int, bytes]:
    """Width, height and samples; raises on a damaged file."""
    head = _HEADER.match(media)
    if not head or head[3] != b"255":
        raise ValueError("not an 8-bit P6 pixmap")
    width, height = int(head[1]), int(head[2])
    samples = media[head.end():]
    if len(samples) != 3 * width * height:
        raise ValueError("the pixmap is cut short")
    return width, height, samples


def features(width: int, height: int, samples: bytes) -> str:
    """An 8 x 8 average hash of the luma (hex), then the channel means to two decimals."""
    px = np.frombuffer(samples, np.uint8).reshape(height, width, 3)
    means = px.reshape(-1, 3).mean(axis=0)
    rows = np.minimum(np.arange(8) * height // 8, height - 1)
    luma = np.add.reduceat(px.sum(axis=2, dtype=np.int64).reshape(height, 8, width // 8).sum(axis=2), np.unique(rows), axis=0)
    spans = np.diff(np.append(np.unique(rows), height))
    grid = (luma / (spans[:, None] * (width // 8)))[np.searchsorted(np.unique(rows), rows)]
    bits = np.packbits(grid >= grid.mean()).tobytes().hex()
    return f"{bits}:{means[0]:.2f},{means[1]:.2f},{means[2]:.2f}"


def payload_media(docs: DataFrame, text: str) -> DataFrame:
    """The media table: (digest, media), digest being the payload's SHA-256. Each text as UTF-8, padded by
    spaces to a positive multiple of 192 bytes, is stored losslessly as samples of a pixmap."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = text_bytes(column(b, text))
            raw = raw.tobytes()
            made: dict[str, bytes] = {}
            for i in range(len(at) - 1):
                n = int(at[i + 1] - at[i])
                payload = raw[at[i] : at[i + 1]].ljust(max(ROW, -(-n // ROW) * ROW))
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in made:
                    made[digest] = encode_pixmap(payload)
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.string()), pa.array(list(made.values()), pa.binary())], ["digest", "media"])

    return docs.select(text).mapInArrow(store, "digest string, media binary")


def describe(media: DataFrame) -> DataFrame:
    """One row per digest, from the stored bytes: sizes, digests of payload and media, checksum, features."""
    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(7)]
            for digest, stored in zip(column(b, "digest").to_pylist(), column(b, "media")):
                stored = stored.as_py()
                width, height, samples = decode_pixmap(stored)
                for col, v in zip(rows, (digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), features(width, height, samples))):
                    col.append(v)
            s, n = pa.string(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (s, n, s, n, n, s, s))], [x.split()[0] for x in schema.split(", ")])

    return media.mapInArrow(read, schema).dropDuplicates(["digest"])


def resolve(seqs: DataFrame, key: str, described: DataFrame) -> DataFrame:
    """One row per media reference of the sequences: (key, position, kind, caption, digest) and the columns of
    ``described``, null where no payload has that digest."""
    refs = seqs.select(key, F.explode("parts").alias("p")).where(F.col("p.digest").isNotNull())
    return refs.select(key, "p.position", "p.kind", "p.caption", "p.digest").join(described, "digest", "left")


def text_pages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A page per text: a heading and a figure that refers to the text's payload by digest."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    size = F.octet_length(raw)
    padded = F.greatest(F.lit(ROW), F.ceil(size / ROW) * ROW).cast("int")
    digest = F.sha2(F.concat(raw, F.repeat(F.lit(" "), padded - size).cast("binary")), 256)
    html = F.concat(F.lit("<h1>Payload</h1><figure><img src='sha256:"), digest, F.lit("'><figcaption>"), size.cast("string"), F.lit(" bytes</figcaption></figure>"))
    return docs.select(F.col(key), size.cast("long").alias("n_bytes"), html.alias("html"))


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_bytes and the features of its stored payload, resolved through its sequence."""
    media = staged(payload_media(docs, text), "media")
    seqs = sequences(text_pages(docs, key, text), key, "html")
    found = resolve(seqs, key, staged(describe(media), "described"))
    return found.select(
        key, F.regexp_extract("caption", r"^(\d+) bytes$", 1).cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256",
        "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
