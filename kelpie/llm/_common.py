"""Helpers shared by the operators: staged tables, word splitting over Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STAGED: dict[str, tuple] = {}  # path: the JVM's file system and path
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()

#: Bytes of a batch that Spark hands to a Python worker.
BATCH_BYTES = 8_000_000
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Lower-cases A-Z; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cases A-Z and blanks every ASCII byte that is neither a digit nor a letter.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. In local mode, where it is unset (as in tests), a
    folder of this machine serves; on a cluster that would lose data, so it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file:///tmp/checkpoints/kelpie"
    return path.rstrip("/")


def _delete(path: str) -> None:
    files, hadoop = _STAGED.pop(path)
    try:
        files.delete(hadoop, True)
    except Exception:  # at exit the JVM may be gone; the folder is a scratch folder
        return


def _drop_staged() -> None:
    for path in list(_STAGED):
        _delete(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, dropped like staged tables."""
    path = f"{shared_dir(spark)}/kelpie-{name}-{uuid.uuid4().hex[:12]}"
    if not _STAGED:
        atexit.register(_drop_staged)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _STAGED[path] = (hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop)  # outlive the session
    return path


def staged(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: cuts the lineage, survives lost
    executors, is computed once. Dropped by ``discard``, ``scratch`` or when the driver's process ends. ``files``: at
    most so many."""
    path = shared_folder(df.sparkSession, name)
    (df.coalesce(files) if files else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Drop staged tables whose consumers have all been written; other DataFrames are left alone."""
    for df in tables:
        if (path := _PATHS.get(df)) in _STAGED:
            _delete(path)


@contextlib.contextmanager
def scratch(*kept: str) -> Iterator[None]:
    """Drops at its end what was staged within, but for tables of the names ``kept``."""
    before = set(_STAGED)
    yield
    for path in set(_STAGED) - before:
        if path.rsplit("/kelpie-", 1)[1].rsplit("-", 1)[0] not in kept:
            _delete(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores if a column of ``df`` has it (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_id(text: str) -> Column:
    """128 bits that stand for a text; null and empty are one."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def partitions(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession) -> None:
    """From now on this session hands Python workers batches of at most ``BATCH_BYTES``, or of one longer row; a setting
    of its own wins. By Spark's default of 64 MB, a batch is 10,000 texts, which task and worker hold several times over."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a batch end to end, and the n + 1 offsets of its texts (null: empty)."""
    texts = texts.cast(pa.string()) if texts.type != pa.string() else texts
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    at = np.frombuffer(offs, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def text_runs(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """``texts`` cut into runs of at most ``most`` bytes, or of one longer text."""
    _, at = text_bytes(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield texts.slice(lo, hi - lo)
        lo = hi


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    col = batch.column(batch.schema.get_field_index(name))
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


class Words:
    """Words of a batch of texts: ``codes`` index ``dictionary``; text i has codes[offsets[i]:offsets[i + 1]]."""

    def __init__(self, texts: pa.Array, table: bytes = LOWER):
        raw, at = text_bytes(texts)
        flat = raw.tobytes().translate(table)
        plain = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat))
        lists = pc.ascii_split_whitespace(plain)
        words, offsets = lists.values, lists.offsets.to_numpy().astype(np.int64)
        full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0 if len(words) else np.zeros(0, bool)
        if not full.all():
            kept = np.concatenate([[0], np.cumsum(full)])
            offsets = kept[offsets]
            words = words.filter(pa.array(full))
        coded = words.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        self.offsets = offsets
        self.dictionary = coded.dictionary

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each dictionary entry."""
        words = self.dictionary.cast(pa.binary()).to_pylist()
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def doc_index(offsets: np.ndarray) -> np.ndarray:
    """For each item the number of the text that holds it."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given lengths."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)
