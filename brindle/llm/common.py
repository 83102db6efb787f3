"""What the operators of this subpackage share: the shared folder, and word hashing in numpy."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import shutil
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):
    # another C library
    _trim = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode, as in tests; an error on a cluster."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        got = sc._jsc.sc().getCheckpointDir()
        if got.isDefined():
            return got.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="brindle-shared-")
        sc.setCheckpointDir(where)
        where = sc._jsc.sc().getCheckpointDir().get()
    return where


def local_path(uri: str) -> str:
    """A file: URI as a path. The mapped files of some operators need the shared folder to be mounted."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri}: memory-mapped files need a shared folder that is mounted as a file system")
    return uri


class Scratch:
    """A folder of its own in the shared folder, for tables that cut lineage and for mapped files."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.uri = f"{shared_dir(spark).rstrip('/')}/brindle-{name}-{uuid.uuid4().hex[:12]}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df here and read it again: later failures go back to these files, not to the input."""
        df.write.mode("overwrite").parquet(f"{self.uri}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.uri}/{name}")

    def written(self, df: DataFrame, name: str, by=None, schema=None, most: int = 16 << 20) -> DataFrame:
        """Like table(), but Python workers write the files, so the shared folder must be mounted. With by and schema, df.mapInArrow(by, schema) is written, by the workers that compute it.

        For each file an executor's JVM starts three processes (chmod of it, its checksum file and
        its folder). Until such a process begins its own program, it shares all memory of the
        JVM, so whoever adds up the processes of an executor counts that twice. Files hold row
        groups of about `most` bytes and checksums of their pages. The driver takes those of the
        tasks that succeeded.
        """
        drafts, folder = self.folder(f"{name}-drafts"), self.folder(name)

        def run(batches):
            own, writer, held, size = f"{uuid.uuid4().hex}.parquet", None, [], 0
            for batch in by(batches) if by else batches:
                if not batch.num_rows:
                    continue
                writer = writer or pq.ParquetWriter(os.path.join(drafts, own), batch.schema, write_page_checksum=True)
                held.append(batch)
                size += batch.nbytes
                if size >= most:
                    writer.write_table(pa.Table.from_batches(held))
                    held, size = [], 0
            if writer:
                if held:
                    writer.write_table(pa.Table.from_batches(held))
                writer.close()
                yield pa.RecordBatch.from_arrays([pa.array([own])], names=["file"])

        for r in df.mapInArrow(releasing(run), "file string").collect():
            os.replace(os.path.join(drafts, r["file"]), os.path.join(folder, r["file"]))
        remove_tree(drafts)
        return self.spark.read.schema(schema or df.schema).option("parquet.page.verify-checksum.enabled", "true").parquet(f"{self.uri}/{name}")

    def folder(self, name: str) -> str:
        path = os.path.join(local_path(self.uri), name)
        os.makedirs(path, exist_ok=True)
        return path

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def publish(path: str, write) -> str:
    """Write a file under a name of this attempt alone, then rename it: a lost or repeated task leaves no half file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        write(f)
    os.replace(temporary, path)
    return path


def release() -> None:
    """Give memory that isn't used any more back to the system: a Python worker stays after its task, beside those of the next one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def releasing(run):
    """A function for mapInArrow that ends with release(), also if its task fails or is stopped."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def remove_tree(path: str) -> None:
    shutil.rmtree(path, ignore_errors=True)


#: Letters of Latin-1 and Latin Extended-A but U+0130, whose lower case is two characters: all composed.
LATIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([!-/:-@\\[-`{-~]*)\\Z").match


def letters_and_marks(chunk: str) -> tuple[str, str] | None:
    """(letters, marks) of a chunk of Latin letters and then nothing but ASCII punctuation; None for any other. Tokenizer patterns split such a chunk there and nowhere else."""
    if chunk.isalpha() and chunk.isascii():
        return chunk, ""
    m = LATIN(chunk)
    return m.groups() if m else None


# ---------------------------------------------------------------- numpy text

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 2 * len(have) if have is not None else 0)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: all bits of the result depend on all bits of x."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty), and where each row begins in them, and the last ends."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """A 64-bit hash of each data[start:end], the same wherever the bytes lie. Spans are in order and don't overlap; they are taken in blocks of bytes, so memory doesn't grow with the text but for one span longer than a block."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + block, "right")))
        high = ends[to - 1]
        part = data[low:high]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_CODE[part] * powers(_P, len(part)), out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * powers(_P_INV, len(part) + 1)[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """The batch in slices of at most so many bytes of text; a longer text comes alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.concatenate(([0], np.cumsum(lengths))), 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    """Words of a column of texts. offsets: where each text's words begin in hashes, and the last ends."""

    data: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray


def words_of(column: pa.Array, lower: bool) -> Words:
    """Words [^\\x20\\x09-\\x0D]+ of each text, hashed; lower: with A-Z as a-z."""
    data, rows = text_buffer(column)
    if lower:
        data = LOWER[data]
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[rows] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | first[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | first[1:])) + 1
    return Words(data, rows, starts, ends, span_hash(data, starts, ends), np.searchsorted(starts, rows))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows that begin at each word but the last n - 1."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out = out * U64(0xD6E8FEB86659FD93) + hashes[k : k + len(out)]
    return mix(out)
