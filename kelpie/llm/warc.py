"""WARC archives and a two-level capture index.

Records are gzip members, gathered into archive files of bounded size in the shared folder. The capture index has
one line per record, sorted by line key: reversed-host URL key, blank and record id as one string, whose order
partitions, blocks and lookups share. Runs of lines are compressed into blocks, which are gzip members of index
files too; a sparse directory (a table) holds the first line key of each block and its range. A lookup finds its
range of the index in a top directory (one key per index partition), its block by binary search in the directory,
reads the block's range, finds its lines by binary search there, and then reads just those ranges of the archives.
Ranges with small gaps between them are read together. A file's name has the id of the attempt that wrote it, so
what a lost or repeated attempt leaves behind is in no table and never read.

Archives grow to ``archive_bytes`` and are read in stretches of ``RUN_BYTES``, so that large ones are spread over
tasks. Files are written and read with Arrow's file systems, so the shared folder's scheme must be one of theirs (file,
hdfs, s3, gs), or one of Hadoop's other names for them (s3a, s3n).

Of records with equal payloads, the one with the largest id is a response, the others are revisits of it.

Defined cases: a null payload is empty; a null URL has the empty key; a null id sorts before all, and revisits the
largest id if there is one; if all ids of equal payloads are null, or several rows share the largest id, each of those
is a response; repeated rows are separate records; a long payload is one record, whatever the size of an archive; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm._common import column, discard, partitions, shared_dir, shared_folder, staged

#: Bytes after which an archive or index file is closed.
ARCHIVE_BYTES = 1_000_000_000
#: Stretch of an archive that one row of work reads, and one read takes at most.
RUN_BYTES = 4_000_000
BLOCK_LINES = 2_000
#: Ranges with a gap up to this are read together.
GAP_BYTES = 4_096
#: Fixed date of records, so that equal input gives equal archives.
DATE = "2024-01-01T00:00:00Z"
CAPTURE = "line string, archive string, offset long, length long"
RECORD = "id long, type string, refers_to long, payload_bytes long, digest string, stated_digest string, url string"


def url_key(url: str | None) -> str:
    """Reversed host, then port, path and query: http://b.example.com/x?y -> com,example,b)/x?y"""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def line_key(url: str | None, id: int | None) -> str:
    """URL key and record id as one string without tabs and newlines; ids of a URL key in order, null first."""
    return re.sub(r"[\t\n]", " ", url_key(url)) + " " + ("" if id is None else f"{id + (1 << 63):020d}")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit leaves its payload out."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if id is None else id}>", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url or ""), f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if revisit:
        head[7:7] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Type, ids and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    _, _, payload = body.partition(b"\r\n\r\n")
    number = lambda name: int(m[1]) if (m := re.search(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    return {"id": number("warc-record-id"), "type": fields["warc-type"], "refers_to": number("warc-refers-to"), "payload": payload, "digest": fields["warc-payload-digest"].removeprefix("sha1:"), "url": fields.get("warc-target-uri", "")}


def gzip_member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def responders(pages: DataFrame, key: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """(sha, responder): the largest id of each payload that several rows have; counted map-side first."""
    raw = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    return pages.select(F.sha1(raw).alias("sha"), F.col(key).alias("id"), F.octet_length(raw).alias("n")).where(F.col("n") >= min_bytes).groupBy("sha").agg(F.max("id").alias("responder"), F.count("*").alias("rows")).where("rows > 1 and responder is not null").select("sha", "responder")


def _files(base: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", base) if ":/" in base else "file://" + base)


class _Writer:
    """Appends members to files of about ``most`` bytes in a folder under ``base``."""

    def __init__(self, base: str, folder: str, most: int):
        self.files, root = _files(base)
        self.root, self.folder, self.most = root.rstrip("/"), folder, most
        self.n, self.stream = 0, None

    def add(self, member: bytes) -> tuple[str, int]:
        """The file, relative to the base, and the offset."""
        if self.stream is None:
            context = TaskContext.get()
            self.name, self.size = f"{self.folder}/{context.partitionId():06d}-{context.taskAttemptId():06d}-{self.n:06d}", 0
            self.files.create_dir(f"{self.root}/{self.folder}", recursive=True)
            self.stream = self.files.open_output_stream(f"{self.root}/{self.name}")
        self.stream.write(member)
        at = self.name, self.size
        self.size += len(member)
        if self.size >= self.most:
            self.close()
        return at

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream, self.n = None, self.n + 1


def read_ranges(file, ranges: list[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes of the ranges (offset, length), sorted by offset, of an open file; ranges with gaps of at most
    ``GAP_BYTES`` come by one read, of ``RUN_BYTES`` and one range at most."""
    i = 0
    while i < len(ranges):
        begin, end, j = ranges[i][0], sum(ranges[i]), i + 1
        while j < len(ranges) and ranges[j][0] - end <= GAP_BYTES and end - begin < RUN_BYTES:
            end, j = max(end, sum(ranges[j])), j + 1
        file.seek(begin)
        held = file.read(end - begin)
        for offset, length in ranges[i:j]:
            yield held[offset - begin : offset - begin + length]
        i = j


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Captures (line, archive, offset, length) of the archive files, which are in the shared folder."""
    spark = pages.sparkSession
    base, folder = _place(spark, "archives")
    shared = staged(responders(pages, key, payload, min_bytes), "responders")
    raw = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), raw.alias("payload"), F.sha1(raw.cast("binary")).alias("sha")).join(shared, "sha", "left")
    rows = rows.select("id", "url", "payload", F.when(F.col("id").isNull() | (F.col("id") != F.col("responder")), F.col("responder")).alias("refers_to"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(base, folder, archive_bytes)
        for b in batches:
            out = []
            for id, link, text, refers in zip(*(column(b, c).to_pylist() for c in ("id", "url", "payload", "refers_to"))):
                member = gzip_member(record_bytes(id, link, text.encode(), refers))
                out.append((line_key(link, id), *writer.add(member), len(member)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["line", "archive", "offset", "length"])
        writer.close()

    written = staged(rows.mapInArrow(pack, CAPTURE), "lines")
    discard(shared)
    return written


def _place(spark: SparkSession, name: str) -> tuple[str, str]:
    """The shared folder and a new one in it."""
    base, folder = shared_folder(spark, name).rsplit("/", 1)
    return base, folder


def build_index(archives: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """The sparse directory (part, block, first, lines, file, offset, length) of the blocks of sorted capture lines,
    which are in files of the shared folder."""
    base, folder = _place(archives.sparkSession, "index")
    lines = archives.repartitionByRange(partitions(archives.sparkSession), "line", "archive", "offset").sortWithinPartitions("line", "archive", "offset")
    names = ["part", "block", "first", "lines", "file", "offset", "length"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, first = TaskContext.get().partitionId(), 0, [], None
        writer = _Writer(base, folder, ARCHIVE_BYTES)

        def flush() -> pa.RecordBatch:
            member = gzip_member("\n".join(held).encode())
            row = (part, n, first, len(held), *writer.add(member), len(member))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for b in batches:
            for line, archive, offset, length in zip(*(column(b, c).to_pylist() for c in ("line", "archive", "offset", "length"))):
                first = first if held else line
                held.append(f"{line}\t{archive}\t{offset}\t{length}")
                if len(held) == block_lines:
                    yield flush()
                    held, n = [], n + 1
        if held:
            yield flush()
        writer.close()

    return staged(lines.mapInArrow(blocks, "part long, block long, first string, lines long, file string, offset long, length long"), "directory")


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(archive, offset, length) of each record whose (url, id) is among wanted(url, id): each asked for once. Of the
    index's files only the blocks that may hold an asked line are read."""
    top = sorted((r["first"], r["part"]) for r in index.where("block = 0").select("part", "first").toLocalIterator())  # one key per partition of the index
    keys = [k for k, _ in top]
    numbers = np.array([p for _, p in top] or [0])
    base = shared_dir(index.sparkSession)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # records of equal keys may go on into the next partitions
            line, part = [], []
            for x in {line_key(u, i) for u, i in zip(column(b, "url").to_pylist(), column(b, "id").to_pylist())}:
                lo, hi = max(0, bisect.bisect_left(keys, x) - 1), max(1, bisect.bisect_right(keys, x))
                line += [x] * (hi - lo)
                part += numbers[lo:hi].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(line, pa.string()), pa.array(part, pa.int64())], ["line", "part"])

    def find(asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if not asked.empty and not blocks.empty:
            blocks = blocks.sort_values("block")
            directory = blocks["first"].tolist()
            places = list(zip(blocks["file"].tolist(), blocks["offset"].tolist(), blocks["length"].tolist()))
            files, root = _files(base)
            opened, at, name, stream = [], -1, None, None
            for x in sorted(set(asked["line"])):
                b = max(0, bisect.bisect_left(directory, x) - 1)
                while b < len(places) and (b == 0 or directory[b] <= x):
                    if b != at:
                        if places[b][0] != name:
                            if stream is not None:
                                stream.close()
                            name = places[b][0]
                            stream = files.open_input_file(f"{root.rstrip('/')}/{name}")
                        opened, at = zlib.decompress(next(read_ranges(stream, [places[b][1:]])), 31).decode().split("\n"), b
                    i = bisect.bisect_left(opened, x, key=lambda y: y.partition("\t")[0])  # a line key may begin another
                    while i < len(opened) and opened[i].startswith(x + "\t"):
                        _, archive, offset, length = opened[i].split("\t")
                        out.append((archive, int(offset), int(length)))
                        i += 1
                    b += 1
            if stream is not None:
                stream.close()
        return pd.DataFrame(out, columns=["archive", "offset", "length"])

    if not top:
        return index.sparkSession.createDataFrame([], "archive string, offset long, length long")
    routed = wanted.select("url", "id").mapInArrow(route, "line string, part long")
    return routed.groupBy("part").cogroup(index.select("part", "block", "first", "file", "offset", "length").groupBy("part")).applyInPandas(find, "archive string, offset long, length long")


def range_read(archives: DataFrame, places: DataFrame) -> DataFrame:
    """The records at places(archive, offset, length), each read by its range: id, type, refers_to, size and
    digest of the payload in the record, the stated digest, and the URL. Other bytes of the archives aren't read."""
    run = F.floor(F.col("offset") / RUN_BYTES).alias("run")  # a run is of bounded size
    ranges = places.groupBy("archive", run).agg(F.sort_array(F.collect_set(F.struct("offset", "length"))).alias("ranges")).drop("run")
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    base = shared_dir(archives.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(base)
        for b in batches:
            for archive, wanted in zip(column(b, "archive").to_pylist(), column(b, "ranges").to_pylist()):
                rows = []
                with files.open_input_file(f"{root.rstrip('/')}/{archive}") as file:
                    for member in read_ranges(file, [(x["offset"], x["length"]) for x in wanted]):
                        r = parse_record(zlib.decompress(member, 31))
                        rows.append((r["id"], r["type"], r["refers_to"], len(r["payload"]), sha1_base32(r["payload"]), r["digest"], r["url"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return ranges.mapInArrow(read, RECORD)


def captures(archives: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per record of wanted(url, id), read back from the archives through the index: id, payload_bytes and
    payload_digest of the full payload (a revisit's is that of the response it refers to), record_type, refers_to."""
    index = build_index(archives)
    read = staged(range_read(archives, lookup(index, wanted)), "records")
    discard(index)
    responses = read.where("type = 'response'").select(F.col("id").alias("refers_to"), F.col("stated_digest"), F.col("payload_bytes").alias("full_bytes"), F.col("digest").alias("full_digest")).dropDuplicates(["refers_to", "stated_digest"])
    needed = read.where("type = 'revisit'").select("refers_to", "stated_digest").distinct()
    responses = staged(responses.join(needed, ["refers_to", "stated_digest"], "left_semi"), "responses")
    return read.join(responses, ["refers_to", "stated_digest"], "left").select(
        "id", F.coalesce("full_bytes", "payload_bytes").alias("payload_bytes"), F.coalesce("full_digest", "digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", "url")
