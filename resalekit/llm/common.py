"""Helpers shared by the training-data operators: staged tables in the shared
folder, size-checked broadcasts, word hashing and Arrow batch slicing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resalekit.session import shared_root

# Arrow's own allocator keeps freed batches; the system's gives them back, so that a
# worker holds no more than what it works on.
pa.set_memory_pool(pa.system_memory_pool())


@functools.lru_cache(maxsize=1)
def _libc():
    """The C library, told to map large arrays one by one, if it can; else None."""
    libc = ctypes.CDLL(None)
    if not hasattr(libc, "malloc_trim"):
        return None
    libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: freed arrays of 1 MB go back at once
    return libc


def give_back() -> None:
    """Return freed memory to the machine: a worker that waits should hold little."""
    if libc := _libc():
        libc.malloc_trim(0)


#: A side is broadcast only when a bounded count finds at most so many rows.
BROADCAST_ROWS = 500_000
#: Text handled at once inside a task.
SLICE_BYTES = 1 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the application ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


#: Of what goes to the Python workers at once, the session's own limit lets a task hold 64 MB several times over.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.execution.arrow.maxRecordsPerBatch": "5000"}


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Jobs that start in here send Arrow batches of a few MB."""
    before = {k: spark.conf.get(k) for k in BATCHES}
    try:
        for k, v in BATCHES.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which
    cuts the lineage: lost executors cost no recomputation of what is before."""
    path = shared_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Paths of the tables staged in each open ``scratch``.
_scratch: list[list[str]] = []


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables that nothing reads any more, and the shuffle files of jobs that are
    over: Spark's cleaner drops those when the driver's garbage collector has met their plans."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    jvm.System.gc()


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are staged in here go at the end, but for those that the given function is
    called with, which returns them. They belong to the scratch around this one, if there is one."""
    own: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        path = own.pop()  # the one that was staged last
        if len(_scratch) > 1:
            _scratch[-2].append(path)
        kept.append(path)
        return df

    kept: list[str] = []
    keep.paths = kept
    _scratch.append(own)
    try:
        yield keep
    finally:
        _scratch.pop()
        discard(spark, own)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint when a bounded count proves at most ``max_rows`` rows;
    else ``df`` as it is, for a shuffle join that adaptive execution may split."""
    return F.broadcast(df) if df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows else df


def lower_ascii(c):
    """A-Z to a-z and nothing else. ``lower`` is the same, and faster, where
    the text has single bytes only."""
    up = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, up, up.lower()))


def mix(a: np.ndarray) -> np.ndarray:
    """A finalizer: every input bit reaches every output bit."""
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


#: A fixed random number for each byte, A-Z as a-z; an odd multiplier and its inverse modulo 2**64.
_BYTE = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
_P = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_P, -1, 1 << 64))


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ..., n - 1, modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and the
    number of words before each text and in all. A word is a run of other bytes than ASCII white space;
    A-Z are as a-z. Null is as empty.

    A word's hash is the polynomial of its bytes' random numbers, from one running
    sum over the bytes, so there is no work per word outside numpy. It takes
    ``SLICE_BYTES`` and the end of a word at a time, so long texts need no more memory."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    first, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    if not size:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data, ends = np.frombuffer(texts.buffers()[2], np.uint8)[first:first + size], offsets - first
    hashes, starts, _ = hash_words(data, ends)
    return hashes, np.searchsorted(starts, ends).astype(np.int64)


def hash_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words in these bytes, which ``ends`` part too."""
    found, a = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))], 0
    while a < len(data):
        b = min(a + SLICE_BYTES - 4096, len(data))  # so that the end of a word fits the tables
        while b < len(data) and not _BLANK[data[b]]:  # no word is cut
            more = _BLANK[data[b:b + 1024]]
            b += int(more.argmax()) if more.any() else len(more)
        h, start, end = _hashes(data[a:b], ends[np.searchsorted(ends, a):np.searchsorted(ends, b, side="right")] - a)
        found.append((h, start + a, end + a))
        a = b
    return tuple(map(np.concatenate, zip(*found)))


def _hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = len(data)
    word = np.zeros(size + 1, bool)
    word[:-1] = ~_BLANK[data]
    cut = np.zeros(size + 1, bool)
    cut[cuts] = True
    before = np.concatenate([[False], word[:-1]])
    start, end = (np.flatnonzero(x) for x in (word & (~before | cut), before & (~word | cut)))
    n = 1 << max(16, (size - 1).bit_length())
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_P, n)[:size], out=sums[1:])
    h = (sums[end] - sums[start]) * _powers(int(_INVERSE), n)[start] + (end - start).astype(np.uint64)
    return mix(h), start, end


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of all texts, in order, and the number of
    shingles before each text and in all. Fewer words, but not none, are one shingle."""
    words, at = word_hashes(texts)
    n = np.diff(at)
    a = np.full(max(0, len(words) - k + 1), k, np.uint64)
    for i in range(k):
        a = (a + words[i:i + len(a)]) * np.uint64(_P)
    inside = np.ones(len(a), bool)
    for back in range(1, k):  # shingles that would run into the next text
        i = at[1:] - back
        inside[i[(i >= 0) & (i < len(a))]] = False
    a = mix(a)[inside]
    counts = np.maximum(n - k + 1, 0)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        ends = np.cumsum(counts)
        own = []
        for t in short.tolist():
            x = n[t:t + 1].astype(np.uint64)
            for i in range(at[t], at[t + 1]):
                x = (x + words[i:i + 1]) * np.uint64(_P)
            own.append(x)
        a = np.insert(a, ends[short] - counts[short], mix(np.concatenate(own)))
        counts[short] = 1
    return a, np.concatenate([[0], np.cumsum(counts)])


def pieces(values: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The values of each text."""
    ends = at.tolist()
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about ``most`` bytes of text each."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(start, end - start)
        start = end
    give_back()


def run_ends(lengths) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run in a concatenation."""
    ends = np.cumsum(np.asarray(lengths, np.int64))
    return ends - lengths, ends
