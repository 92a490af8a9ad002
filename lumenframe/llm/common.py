"""Shared helpers of the corpus operators: scratch space, vectorised words, packed exchanges.

Words are found and hashed with numpy straight on Arrow's text buffers, so no Python string
is made for a word.  A word's identity is a 64-bit polynomial hash of its bytes, mixed with its
length; a window's identity is the same kind of hash over its words.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
_BYTE_BASE, _WORD_BASE, _WORD_BASE_2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)
_SECTION = 1 << 18  # bytes or words hashed at once, which bounds the tables of powers
PIECE = 4 << 20  # bytes of text that an operator works on at once, but for a longer text
CHUNK = 32 << 20  # bytes of text in a chunk at most, about
BUCKET = 64 << 20  # bytes of text whose keys make a bucket at most, about: some ten million keys
#: What a worker keeps between tasks, by key; an operator that needs none of it empties it.
KEPT: dict = {}
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes that separate words: space and 0x09-0x0D, or whatever is not a digit, letter or non-ASCII byte.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:128] = [not (chr(i).isdigit() or chr(i).islower()) for i in range(128)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package even where only the driver's path holds it, and get texts in small batches."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    env["ARROW_DEFAULT_MEMORY_POOL"] = "system"  # so that release() gives back what Arrow has freed
    if spark.conf.get(BATCH) == "10000":  # Spark's default: as many long texts would be held on both sides of the pipe
        spark.conf.set(BATCH, "1000")


def release() -> None:
    """Give a worker's freed memory back, so that idle workers hold little; called where a task ends."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def released(f):
    """An Arrow function of batches that releases memory at its end."""

    @wraps(f)
    def run(*args):
        try:
            yield from f(*args)
        finally:
            release()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only in local mode, where none is set."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "/tmp/checkpoints"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Scratch folders since a pipeline's first stage began, for its later stages to sweep.
SCRATCH: list[str] = []


def scratch(spark: SparkSession, name: str, swept: bool = True) -> str:
    path = f"{shared_dir(spark)}/lumenframe-{name}-{uuid.uuid4().hex}"
    if swept:
        SCRATCH.append(path)
    return path


def stored(df: DataFrame, name: str, swept: bool = True) -> DataFrame:
    """df written to the shared folder and read again: a lost executor costs no recomputation.  A folder that is not swept is the caller's to discard."""
    path = scratch(df.sparkSession, name, swept)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


PART = 4 << 20  # bytes in a partition of a gathered table, about


@contextlib.contextmanager
def gathered(df: DataFrame, *long: str):
    """df in partitions of about PART bytes, to be written within the block.

    It is computed once, in its own partitions, to the executors' disks, and those few read that: where Hadoop has no native
    library, each file that is written starts a process or more.  long: columns that make a row longer than 128 bytes, about.
    """
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        row = F.lit(128)
        for name in long:
            row = row + F.coalesce(F.octet_length(name), F.lit(0))
        size = held.select(F.sum(row)).first()[0] or 0
        yield held.coalesce(max(1, -(-size // PART)))
    finally:
        held.unpersist()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Delete the scratch folders of operators whose results have been written: what a pipeline's next stage may do, as it is given them reread."""
    while SCRATCH:
        _delete(spark, SCRATCH.pop())


def discard(df: DataFrame) -> None:
    """Delete the folder of a stored table that nothing reads any more."""
    for folder in {os.path.dirname(x) for x in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def file_system(uri: str):
    """Arrow's file system of a shared folder or file, and the path in it."""
    return pa.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before those that df has already."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


# ---------------------------------------------------------------- words


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of an Arrow text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks])
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.buffers()
    if not len(column) or raw[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least; tables of ordinary sections are kept."""
    key = int(base)
    if key in _TABLES and len(_TABLES[key][0]) >= n:
        return _TABLES[key]
    size, tables = max(n, _SECTION + 1024), []
    for b in (key, pow(key, -1, 1 << 64)):
        t = np.ones(size, U)
        have = 1
        while have < size:
            to = min(2 * have, size)
            t[have:to] = t[: to - have] * U(pow(b, have, 1 << 64))
            have = to
        tables.append(t)
    if n <= _SECTION + 1024:
        _TABLES[key] = tables[0], tables[1]
    return tables[0], tables[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _section_words(data: np.ndarray, heads: np.ndarray, separators: np.ndarray):
    gap = separators[data]
    word = ~gap
    begin, end = word.copy(), word.copy()
    begin[1:] &= gap[:-1]
    begin[heads] = word[heads]
    end[:-1] &= gap[1:]
    heads = heads[heads > 0]
    end[heads - 1] = word[heads - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
    pw, inv = powers(_BYTE_BASE, len(data) + 1)
    total = np.cumsum((data.astype(U) + U(1)) * pw[: len(data)], dtype=U)
    hashes = total[ends]
    hashes[1:] -= total[starts[1:] - 1]
    if len(starts) and starts[0]:
        hashes[0] -= total[starts[0] - 1]
    hashes *= inv[starts]
    return mix(hashes ^ ((ends - starts + 1).astype(U) << U(40))), starts, ends + 1


def words(column, separators: np.ndarray = SPACES, lower: bool = False):
    """Of a text column: hash, first and last-plus-one byte of every word, and n+1 word offsets of the rows."""
    data, offsets = buffers(column)
    if lower:
        data = LOWER[data]
    heads = offsets[:-1][offsets[1:] > offsets[:-1]]
    parts, at = [], 0
    while at < len(data):
        to = min(len(data), at + _SECTION)
        while to < len(data) and not separators[data[to]]:  # a word is never cut
            nxt = np.flatnonzero(separators[data[to : to + 65536]])
            to = to + nxt[0] if len(nxt) else min(len(data), to + 65536)
        h, s, e = _section_words(data[at:to], heads[np.searchsorted(heads, at) : np.searchsorted(heads, to)] - at, separators)
        parts.append((h, s + at, e + at))
        at = to
    if not parts:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, np.zeros(len(offsets), np.int64)
    hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, rows: np.ndarray, k: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows that start at each word, and whether one lies within its row."""
    n = len(hashes)
    fits = np.zeros(n, bool)
    out = np.zeros(n, U)
    if n >= k:
        base = _WORD_BASE_2 if second else _WORD_BASE
        for at in range(0, n - k + 1, _SECTION):
            part = hashes[at : at + _SECTION + k - 1]
            m = len(part) - k + 1
            pw, inv = powers(base, len(part) + 1)
            total = np.zeros(len(part) + 1, U)
            np.cumsum(part * pw[: len(part)], dtype=U, out=total[1:])
            out[at : at + m] = mix((total[k:] - total[:m]) * inv[:m] + U(k))
        last = np.repeat(rows[1:], np.diff(rows))  # end of the row of each word
        fits = np.arange(n) + k <= last
    return out, fits


def pieces(batch: pa.RecordBatch, text: str, most: int = PIECE):
    """The batch in slices of at most that many bytes of text, or a single row."""
    column = batch.column(text)
    _, at = buffers(column)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield batch.slice(i, min(j, batch.num_rows) - i)
        i = j


def covered(marks: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in one of the k-word windows that start at the marked words."""
    step = np.zeros(len(marks) + k, np.int32)
    step[: len(marks)] += marks
    step[k:] -= marks
    return np.cumsum(step)[: len(marks)] > 0


def isin_sorted(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


# ---------------------------------------------------------------- packed exchanges


def pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def unpack(column, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) for x in column]


def composite(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of n in the upper half, 32 bits of the key in the lower."""
    return (((keys >> U(32)) * U(n)) >> U(32)) << U(32) | (keys & U(0xFFFFFFFF))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> U(32)) * U(n)) >> U(32)


def slices(sorted_ids: np.ndarray):
    """(id, slice) of every run of a sorted array."""
    if len(sorted_ids):
        cuts = np.flatnonzero(sorted_ids[1:] != sorted_ids[:-1]) + 1
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(sorted_ids)), strict=True):
            yield int(sorted_ids[a]), slice(int(a), int(b))


def runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    n = len(sorted_keys[0])
    first = np.ones(n, bool)
    if n:
        first[1:] = False
        for k in sorted_keys:
            first[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(first)


CHUNKS_PER_PARTITION = 4


def chunk_count(docs: DataFrame, text: str) -> int:
    """Four to a partition, or as many as it takes for none to hold over CHUNK bytes of text, about."""
    return chunks_and_buckets(docs, text)[0]


def chunks_and_buckets(docs: DataFrame, text: str) -> tuple[int, int]:
    """Chunks, and buckets of keys: one to a partition, or as many as it takes for none to hold the keys of over BUCKET bytes of text, about.

    Each chunk sends a row to each bucket that it has keys of, so an exchange has no more rows than keys, whatever the numbers.
    """
    n, size = partitions(docs.sparkSession), docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    return max(n * CHUNKS_PER_PARTITION, -(-size // CHUNK)), max(n, -(-size // BUCKET))


def chunk_of(n: int, *columns) -> F.Column:
    """The chunk of a row, by a hash of its columns.

    Equal rows meet in one chunk whatever partition they were read from, so a chunk has the same
    rows each time that it is computed, after the loss of an executor too.
    """
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def dealt(df: DataFrame, key: str = "chunk") -> DataFrame:
    return df.repartition(partitions(df.sparkSession), key)


def hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]


def cogrouped(left: DataFrame, right: DataFrame, f, schema: str | object, key: str = "chunk") -> DataFrame:
    return dealt(left, key).groupBy(key).cogroup(dealt(right, key).groupBy(key)).applyInArrow(f, schema)


def grouped(df: DataFrame, f, schema: str | object, key: str) -> DataFrame:
    return dealt(df, key).groupBy(key).applyInArrow(f, schema)
