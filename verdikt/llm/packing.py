"""Hierarchical multi-length packing.

Documents become token ids of a public tokenizer plus an end id. Within a partition, a pool of documents is packed at a
time: full windows of the longest context are cut from long documents; what is left, and shorter documents, go to the
smallest context tier (256, 512, 1,024 or 2,048 ids) that holds them. Each tier's windows are packed longest first, and a
window's gap is filled by the longest document of its own or a shorter tier that fits, at last by a cut from the shortest
one. A window that can't be filled waits for the next pool. At the end of a partition the rest is cut at powers of two, so
no sequence needs padding. The windows of a pool are dealt to step groups of equal size, the longest first to the
emptiest group.

One pass without a shuffle: a partition needs its own documents only, a lost one is packed again alike. Memory holds a
pool, a block of texts and the ids of one document. Ids come from ``tokens.Ids``.

Defined results: a null or empty text has its end id alone; rows that repeat a doc_id are packed as documents of their
own; null doc_ids are kept; an empty table gives no rows; only doc_id (as a long) and text are read. ``sequence_id`` holds the
partition's number in its high bits.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import blocks, small_batches
from .tokens import Ids

TIERS = (256, 512, 1024, 2048)
END = 1
POOL_TOKENS, STEP_TOKENS = 1 << 20, 16 * 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids array<int>"


_coders: dict[str, Ids] = {}


def coder_of(path: str) -> Ids:
    """One for each worker process, so that it serves the tasks that come after."""
    if path not in _coders:
        _coders[path] = Ids(path)
    return _coders[path]


class Packer:
    """Pieces are (document, start, length); a document is [doc_id, ids as bytes, tokens]."""

    def __init__(self, tiers: tuple[int, ...]) -> None:
        self.tiers = tiers
        self.pool: list[list[tuple]] = [[] for _ in tiers]  # by tier, sorted by length
        self.docs: dict[int, list] = {}
        self.tokens = self.made = 0
        self.windows: list[tuple[int, list[tuple[int, int, int]]]] = []

    def add(self, doc_id, ids: bytes) -> None:
        n, top, k = len(ids) // 4, self.tiers[-1], self.made
        self.made += 1
        self.docs[k] = [doc_id, ids, n]
        for start in range(0, n - n % top, top):
            self.windows.append((top, [(k, start, top)]))
        if n % top:
            self._put(n % top, k, n - n % top)
        self.tokens += n

    def _put(self, length: int, k: int, start: int) -> None:
        bisect.insort(self.pool[bisect.bisect_left(self.tiers, length)], (length, k, start))

    def _largest(self, most: int, tier: int) -> tuple | None:
        """The longest piece of at most that length in a tier up to the given one."""
        for t in range(min(tier, bisect.bisect_left(self.tiers, most)), -1, -1):
            if (at := bisect.bisect_right(self.pool[t], (most, float("inf"), 0))) > 0:
                return self.pool[t].pop(at - 1)
        return None

    def _shortest(self) -> tuple | None:
        for p in self.pool:
            if p:
                return p.pop(0)
        return None

    def pack(self) -> None:
        """Fill windows tier by tier; the pieces of a window that stays open go back."""
        for tier in range(len(self.tiers) - 1, -1, -1):
            while self.pool[tier]:
                gap, parts = self.tiers[tier], []
                while gap:
                    piece = self._largest(gap, tier) or self._shortest()
                    if piece is None:
                        break
                    length, k, start = piece
                    used = min(gap, length)
                    parts.append((k, start, used))
                    gap -= used
                    if used < length:
                        self._put(length - used, k, start + used)
                if gap:
                    for k, start, used in parts:
                        self._put(used, k, start)
                    return
                self.windows.append((self.tiers[tier], parts))

    def finish(self) -> None:
        """Cut what is left at powers of two."""
        rest = deque(x for p in reversed(self.pool) for x in reversed(p))
        self.pool = [[] for _ in self.tiers]
        left = sum(x[0] for x in rest)
        while left:
            size = gap = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            parts = []
            while gap:
                length, k, start = rest.popleft()
                used = min(gap, length)
                parts.append((k, start, used))
                gap -= used
                if used < length:
                    rest.appendleft((length - used, k, start + used))
            left -= size
            self.windows.append((size, parts))

    def taken(self) -> list[tuple[int, list[tuple[int, int, int]], int]]:
        """The filled windows with their step groups; documents without pieces left are forgotten."""
        total = sum(w[0] for w in self.windows)
        loads = [(0, g) for g in range(max(1, -(-total // STEP_TOKENS)))]
        out = []
        for size, parts in sorted(self.windows, key=lambda w: -w[0]):
            load, g = heapq.heappop(loads)
            heapq.heappush(loads, (load + size, g))
            out.append((size, parts, g))
        self.windows = []
        self.tokens = sum(x[0] for p in self.pool for x in p)
        return out

    def forget(self) -> None:
        held = {k for p in self.pool for _, k, _ in p}
        self.docs = {k: d for k, d in self.docs.items() if k in held}


def _packed(path: str, tiers: tuple[int, ...], with_ids: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = coder_of(path), Packer(tiers)
        sequence = group = TaskContext.get().partitionId() << 40
        end = np.array([END], "<u4").tobytes()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, group
            rows, most = [], 0
            for size, parts, g in packer.taken():
                offset = 0
                for k, start, length in parts:
                    doc_id, ids, n = packer.docs[k]
                    raw = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, length, zlib.crc32(raw), n, sequence, offset, size, group + g, np.frombuffer(raw, "<i4") if with_ids else None))
                    offset += length
                sequence, most = sequence + 1, max(most, g + 1)
            group += most
            packer.forget()
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.list_(pa.int32())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

        for b in blocks(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc_id, ids in zip(b.column(0).to_pylist(), coder.of(texts), strict=True):
                packer.add(doc_id, ids.tobytes() + end)
                if packer.tokens >= POOL_TOKENS:
                    packer.pack()
                    yield from flush()
        packer.pack()
        packer.finish()
        yield from flush()

    return pack


def pack(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, with_ids: bool = True) -> DataFrame:
    """One row for each piece of each document of ``docs`` (doc_id, text), with its ids unless ``with_ids`` is false."""
    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_packed(tokenizer_path, tiers, with_ids), SCHEMA)


def digest(out: DataFrame) -> DataFrame:
    return out.drop("ids")
