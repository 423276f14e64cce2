"""Token-ID output in bit-plane files (operator 6).

File format ``BPS1`` (integers little-endian). A file holds the documents of
one range of doc_id, ascending::

    chunk*  footer

    chunk   u32 ids in it, u8 planes, u32 bytes of each plane, planes
    footer  zstd(doc table) zstd(chunk index) trailer
    trailer u32 bytes of doc table, u32 bytes of index, u64 ids, magic "BPS1"

A chunk has ``block`` ids (the last may have fewer). Its ids are transposed:
plane b holds bit b (or byte b) of every id, compressed with zstandard alone;
an all-zero plane has no bytes. The doc table is, for each document, u8 "has an
id", i64 doc_id, u32 ids. The index is u64 offset, u64 first id, u32 ids for
each chunk. Spark's text writer streams the binary rows to any file system and
sets ``SEPARATOR`` after each; offsets count it. It begins a new file every ``FILE_ROWS`` rows: a file that is
followed by another of its task has empty rows before its footer, which nothing points to.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, shared_path, slices
from .tokens import ENCODE_BYTES, encode, forget

MAGIC, SEPARATOR = b"BPS1", "\n"
BLOCK = 1 << 16
#: Rows of a file at most (chunks and the footer; some 130 MB), and text for each task.
FILE_ROWS, TASK_BYTES = 1024, 1 << 26
DOCS = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("n", "<u4")])
INDEX = np.dtype([("offset", "<u8"), ("first", "<u8"), ("n", "<u4")])
TRAILER = np.dtype([("docs", "<u4"), ("index", "<u4"), ("ids", "<u8"), ("magic", "S4")])


def pack_chunk(ids: np.ndarray, planes: str = "bit", level: int = 1) -> bytes:
    """One chunk of the file format; the number of planes (32 or 4) names their kind."""
    z = zstandard.ZstdCompressor(level=level)
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    out = []
    for byte in rows:
        byte = np.ascontiguousarray(byte)
        for b in range(8) if planes == "bit" else (None,):
            plane = byte if b is None else np.packbits((byte >> b) & 1) if byte.any() else byte[:0]
            out.append(z.compress(plane.tobytes()) if plane.any() else b"")
    head = np.array([len(ids)], "<u4").tobytes() + bytes([len(out)])
    return head + np.array([len(p) for p in out], "<u4").tobytes() + b"".join(out)


def unpack_chunk(data: memoryview) -> np.ndarray:
    n, k = int(np.frombuffer(data, "<u4", 1)[0]), data[4]
    sizes, at, z = np.frombuffer(data, "<u4", k, 5), 5 + 4 * k, zstandard.ZstdDecompressor()
    rows = np.zeros((4, n), np.uint8)
    for p, size in enumerate(map(int, sizes)):
        if size:
            plane = np.frombuffer(z.decompress(data[at:at + size], max_output_size=n), np.uint8)
            if k == 4:
                rows[p] = plane
            else:
                rows[p // 8] |= np.unpackbits(plane, count=n) << (p % 8)
        at += size
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


def _file(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, block: int, planes: str, rows: int) -> Iterator[bytes]:
    """The rows of the files of a task, ``rows`` for each but the last. A document lies in one file; one that
    is too long for so many chunks has a file of larger ones."""
    docs, index, offset, first = [], [], 0, 0
    held, have, total, size = [], 0, 0, block

    def chunk(ids):
        nonlocal offset, first
        data = pack_chunk(ids, planes)
        index.append((offset, first, len(ids)))
        offset, first = offset + len(data) + len(SEPARATOR), first + len(ids)
        return data

    def close(more: bool):
        nonlocal docs, index, offset, first, held, have, total
        if have:
            yield chunk(np.concatenate(held))
        for _ in range(rows - 1 - len(index) if more else 0):
            yield b""
        z = zstandard.ZstdCompressor()
        a, b = (z.compress(np.array(x, kind).tobytes()) for x, kind in ((docs, DOCS), (index, INDEX)))
        yield a + b + np.array([(len(a), len(b), first, MAGIC)], TRAILER).tobytes()
        docs, index, offset, first, held, have, total = [], [], 0, 0, [], 0, 0

    end = np.array([end_id], np.uint32)
    for batch in batches:
        for part in slices(batch, most=ENCODE_BYTES):
            for key, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist(), tokenizer)):
                n = len(ids) + 1
                if docs and total + n > (rows - 1) * block:
                    yield from close(True)
                if not docs:
                    size = max(block, -(-n // (rows - 1)))
                docs.append((key is not None, key or 0, n))
                held += [ids, end]
                have, total = have + n, total + n
                if have >= size:
                    ready = np.concatenate(held)
                    for at in range(0, have - size + 1, size):
                        yield chunk(ready[at:at + size])
                    held = [ready[have // size * size:].copy()]
                    have = len(held[0])
    forget(tokenizer)
    if docs:
        yield from close(False)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block: int = BLOCK,
                      planes: str = "bit", rows_per_file: int = FILE_ROWS, task_bytes: int = TASK_BYTES) -> None:
    """Encode ``text`` of ``docs`` and write the ids, each document's with
    ``end_id`` after them, in ascending doc_id order over the files.

    ``docs`` is range-partitioned by doc_id, then size and a row number, so rows with one doc_id, or equal ones, are
    many tasks' if they are many; the number of tasks grows with the bytes of text. A task holds the doc table of a file, one
    slice of texts and one chunk; a file has ``rows_per_file`` rows (2 at least) at most, however many documents a task has. Null or empty
    text: the end id alone. Null doc_id: first. Rows with the same doc_id lie side by side, shorter text
    first. No rows: no files with documents. Other columns are not read."""

    def run(batches):
        for data in _file(batches, tokenizer, end_id, block, planes, rows_per_file):
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])

    total = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // task_bytes))
    order = ["doc_id", "size", "salt"]
    # the number of a row in its scan: a scan that runs again gives the same
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.octet_length("text").alias("size"),
                       F.monotonically_increasing_id().alias("salt"))
    rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, "data binary")
    out = rows.select(F.col("data").cast("string").alias("value")).write.option("lineSep", SEPARATOR)
    out.option("maxRecordsPerFile", rows_per_file).text(path)


def _place(path: str) -> tuple[int, ...]:
    """The task of a file, and which of the task's files it is."""
    found = re.search(r"part-(\d+)-.*?-c(\d+)", path.rsplit("/", 1)[-1])
    return tuple(map(int, found.groups())) if found else ()


def _footer(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Doc table and chunk index of a file."""
    end = len(data) - len(SEPARATOR)
    t = np.frombuffer(data, TRAILER, 1, end - TRAILER.itemsize)[0]
    if t["magic"] != MAGIC:
        raise ValueError("not a BPS1 file")
    at, z = end - TRAILER.itemsize - int(t["docs"]) - int(t["index"]), zstandard.ZstdDecompressor()
    a, b = data[at:at + int(t["docs"])], data[at + int(t["docs"]):end - TRAILER.itemsize]
    return np.frombuffer(z.decompress(a), DOCS), np.frombuffer(z.decompress(b), INDEX)


def _documents(data: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids before it in this file, its ids) one after the other, with
    little more than a chunk and a document in memory."""
    docs, index = _footer(data)
    view, held, have, start, c = memoryview(data), [], 0, 0, 0
    for known, doc_id, n in docs.tolist():
        while have < n:
            held.append(unpack_chunk(view[int(index[c]["offset"]):]))
            have, c = have + len(held[-1]), c + 1
        ids = held[0] if len(held) == 1 else np.concatenate(held)
        yield doc_id if known else None, start, ids[:n]
        held, have, start = [ids[n:]], have - n, start + n


def read_token_files(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it, over
    all files), n_tokens, ids_crc32 (of the little-endian uint32 ids) and, if
    asked for, ids. What is broadcast is a row per file, behind a size check."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0")

    def totals(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                docs, _ = _footer(data.as_py())
                first = int(docs[0]["doc_id"]) if docs[0]["known"] else None
                yield pa.RecordBatch.from_pydict({"path": [name], "first": pa.array([first], pa.int64()),
                                                  "n": pa.array([int(docs["n"].sum(dtype=np.int64))], pa.int64())})

    def rows(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                held, size = [], 0
                for row in _documents(data.as_py()):
                    held.append(row)
                    size += len(row[2])
                    if size > 1 << 20:
                        yield _rows(name, held, ids)
                        held, size = [], 0
                if held:
                    yield _rows(name, held, ids)

    kinds = "path string, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * ids
    # one row per file: few, however many documents there are
    found = [tuple(r) for r in files.select("path", "content").mapInArrow(totals, "path string, first bigint, n bigint").toLocalIterator()]
    before, by_file = 0, []
    for path_, _, n in sorted(found, key=lambda r: (r[1] is not None, r[1] or 0, _place(r[0]), r[0])):
        by_file.append((path_, before))
        before += n
    base = broadcast_if_small(spark.createDataFrame(by_file, "path string, base bigint"))
    out = files.select("path", "content").mapInArrow(rows, kinds).join(base, "path")
    more = ["ids"] if ids else []
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *more)


def _rows(name: str, held: list, ids: bool) -> pa.RecordBatch:
    cols = {"path": pa.array([name] * len(held)), "doc_id": pa.array([r[0] for r in held], pa.int64()),
            "at": pa.array([r[1] for r in held], pa.int64()), "n_tokens": pa.array([len(r[2]) for r in held], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(np.ascontiguousarray(r[2], "<u4").tobytes()) for r in held], pa.int64())}
    if ids:
        cols["ids"] = pa.array([r[2].astype(np.int32) for r in held], pa.list_(pa.int32()))
    return pa.RecordBatch.from_pydict(cols)


def write_and_read(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write ``docs`` to new files in the shared folder and read them back."""
    path = shared_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, **options)
    return read_token_files(docs.sparkSession, path, ids=False)
