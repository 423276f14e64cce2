"""Hierarchical multi-length packing (operator 9).

Tiers are the powers of two from ``shortest`` to ``longest``. A document is
routed by its length: as many ``longest`` windows as it fills alone, and a rest
that goes to the smallest tier that holds it. Each tier packs its rests, longest
first, into windows of its size; the gaps of a tier's windows are filled from
the shorter tiers, longest piece that fits first, and what still gapes by
cutting the next document there. The few tokens that remain of a block are cut
into powers of two, which need no padding. Windows are dealt to step groups,
longest first to the group with the fewest tokens, so that groups are balanced.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import ENCODE_BYTES, encode, forget

LONGEST, SHORTEST = 4096, 256
#: Ids that are packed together; a task holds them once.
BLOCK_IDS = 2 << 20
GROUP = 8

PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, sequence_length bigint, tier int, step_group bigint")


class _Tier:
    """Rests (document, start, length) by length."""

    def __init__(self):
        self.rests: list[tuple[int, int, int]] = []  # (length, document, start), ascending

    def add(self, doc: int, start: int, length: int) -> None:
        insort(self.rests, (length, doc, start))

    def take(self, most: int) -> tuple[int, int, int] | None:
        """The longest rest of at most ``most`` tokens."""
        at = bisect_right(self.rests, (most, 1 << 62, 0))
        return self.rests.pop(at - 1) if at else None


def pack(lengths: list[int], longest: int = LONGEST, shortest: int = SHORTEST) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (tier, [(document, start, length)]) that hold every token of
    documents of these lengths once. All are full but those that ended the
    block, which are powers of two."""
    sizes = [longest]
    while sizes[-1] > shortest:
        sizes.append(sizes[-1] // 2)
    tiers, out = {s: _Tier() for s in sizes}, []

    def route(doc, start, length):
        while length >= longest:
            out.append((longest, [(doc, start, longest)]))
            start, length = start + longest, length - longest
        if length:
            tiers[min(s for s in sizes if s >= length)].add(doc, start, length)

    for doc, n in enumerate(lengths):
        route(doc, 0, n)
    left = []
    for size in sizes:  # from the longest tier to the shortest
        own = tiers[size]
        while own.rests:
            n, doc, start = own.rests.pop()
            window, gap = [(doc, start, n)], size - n
            for s in [s for s in sizes if s <= size]:
                while gap and (found := tiers[s].take(gap)):
                    window.append((found[1], found[2], found[0]))
                    gap -= found[0]
            if gap:  # no rest fits: cut the shortest one of those that are left
                donor = next((tiers[s] for s in reversed(sizes) if s <= size and tiers[s].rests), None)
                if donor is None:
                    left += window
                    continue
                n, doc, start = donor.rests.pop(0)
                window.append((doc, start, gap))
                route(doc, start + gap, n - gap)
            out.append((size, window))
    total = sum(n for _, _, n in left)  # windows that nothing was left to fill: exact powers of two
    cuts = [longest] * (total // longest) + [1 << b for b in reversed(range(longest.bit_length())) if total % longest >> b & 1]
    left.reverse()
    for size in cuts:
        window, gap = [], size
        while gap:
            doc, start, n = left.pop()
            window.append((doc, start, min(n, gap)))
            if n > gap:
                left.append((doc, start + gap, n - gap))
            gap -= min(n, gap)
        out.append((size, window))
    return out


def step_groups(sizes: list[int], per_group: int = GROUP) -> list[int]:
    """A group for each window: longest first, each to the group with the fewest tokens."""
    heap = [(0, g) for g in range(max(1, -(-len(sizes) // per_group)))]
    group = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        tokens, g = heapq.heappop(heap)
        group[i] = g
        heapq.heappush(heap, (tokens + sizes[i], g))
    return group


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, longest: int = LONGEST, shortest: int = SHORTEST,
                   block_ids: int = BLOCK_IDS, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, and sequence_length, tier, step_group (and
    ids, if asked for).

    Each task packs what it reads, ``block_ids`` ids (and the end of a document)
    at a time: no shuffle, memory bounded by a block, and the same pieces when
    the task runs again. Sequence and group ids hold the task's number above
    their own. Null or empty text: the end id alone. Rows with a null or
    repeated doc_id are documents of their own. No rows: no pieces. Other
    columns are not read."""
    schema = PIECES + ", ids array<int>" * with_ids

    def block(held: list[tuple[int | None, np.ndarray]], base: int, group_base: int):
        windows = pack([len(ids) for _, ids in held], longest, shortest)
        groups = step_groups([size for size, _ in windows])
        rows = []
        for w, (size, window) in enumerate(windows):
            offset, length = 0, sum(n for _, _, n in window)
            for doc, start, n in window:
                key, ids = held[doc]
                piece = ids[start:start + n]
                rows.append((key, start, n, zlib.crc32(piece.tobytes()), len(ids), base + w, offset, length, size,
                             group_base + groups[w], *([piece.astype(np.int32)] if with_ids else [])))
                offset += n
        return rows, len(windows), max(groups, default=-1) + 1

    def run(batches):
        task = TaskContext.get().partitionId() << 36
        sequence, group, held, size = task, task, [], 0
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int64()] * 8 + [pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

        def flush():
            nonlocal sequence, group, held, size
            rows, n, g = block(held, sequence, group)
            sequence, group, held, size = sequence + n, group + g, [], 0
            for at in range(0, len(rows), 20_000):
                cols = zip(*rows[at:at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for batch in batches:
            for part in slices(batch, most=ENCODE_BYTES):
                for key, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist(), tokenizer)):
                    held.append((key, np.append(ids, np.uint32(end_id)).astype("<u4")))
                    size += len(ids) + 1
                    if size >= block_ids:
                        yield from flush()
        forget(tokenizer)
        if held:
            yield from flush()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)
