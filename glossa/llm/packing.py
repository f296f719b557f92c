"""Hierarchical multi-length packing of token ids.

A document's ids are cut into full windows of the longest tier; the rest is routed to the smallest tier that holds it.
Tiers are packed from long to short: a document opens a window of its tier, the gap is filled with the longest fitting
pieces of shorter tiers, and what gap is left by cutting one more piece, so windows end up exactly full. Full windows are
dealt to step groups of about STEP tokens, the longest first to the lightest group, so every group costs the same.

Packing works on the rows of one input partition, in rounds of ROUND tokens; what a round can't fill goes on to the next,
so at most one window per partition is short. Nothing is shuffled, a task's result depends on its input split alone, and
memory is bounded by a round and one document. Sequence ids are (partition << 40) + counter.

Defined results: a null or empty text is the end id alone; each input row is packed once, repeated rows too; an empty
table gives no rows. Each id of a document lies in exactly one piece.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import common, wordbpe

TIERS, END_ID, ROUND, STEP = (256, 512, 1024, 2048), 1, 2_000_000, 64 * 2048

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Plans windows over documents given by (key, tokens); a piece is (key, start, length)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = sorted(tiers)
        self.pool: list[tuple[int, int, int]] = []  # (length, key, start), shortest first
        self.full: list[list[tuple[int, int, int]]] = []

    def add(self, key: int, tokens: int) -> None:
        most = self.tiers[-1]
        for start in range(0, tokens - most + 1, most):
            self.full.append([(key, start, most)])
        if rest := tokens % most:
            insort(self.pool, (rest, key, tokens - rest))

    def _window(self) -> tuple[list[tuple[int, int, int]], int]:
        """Opens a window with the longest piece and fills it; the pieces and the gap that is left."""
        length, key, start = self.pool.pop()
        tier = self.tiers[bisect_left(self.tiers, length)]
        pieces, gap = [(key, start, length)], tier - length
        while gap and self.pool:
            at = bisect_right(self.pool, (gap, float("inf"), 0)) - 1
            if at >= 0:
                n, key, start = self.pool.pop(at)
                pieces.append((key, start, n))
                gap -= n
            else:  # all that are left are longer than the gap: the shortest gives its head
                n, key, start = self.pool.pop(0)
                pieces.append((key, start, gap))
                insort(self.pool, (n - gap, key, start + gap))
                gap = 0
        return pieces, gap

    def round(self, last: bool) -> list[list[tuple[int, int, int]]]:
        """Windows that are full; with last, the short one too. Pieces of a short window wait for the next round."""
        while self.pool:
            pieces, gap = self._window()
            if gap and not last:
                for key, start, n in pieces:
                    insort(self.pool, (n, key, start))
                break
            self.full.append(pieces)
        out, self.full = self.full, []
        return out


def step_groups(sizes: list[int], step: int = STEP) -> list[int]:
    """A group for each window, all groups about equally heavy."""
    groups = max(1, round(sum(sizes) / step))
    heap, out = [(0, g) for g in range(groups)], [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        load, g = heapq.heappop(heap)
        out[k] = g
        heapq.heappush(heap, (load + sizes[k], g))
    return out


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = END_ID, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece. Sequences of a power of two need no padding; the others are padded to the longest tier."""

    def run(batches):
        tool, packer, end = wordbpe.encoder(vocabulary), Packer(tiers), end_id.to_bytes(4, "little")
        base, step_base = TaskContext.get().partitionId() << 40, TaskContext.get().partitionId() << 24
        held: dict[int, list] = {}  # key: [doc_id, ids, tokens not yet placed]
        fresh = count = groups = key = 0

        def out(windows):
            nonlocal count, groups
            sizes = [sum(n for _, _, n in w) for w in windows]
            dealt = step_groups(sizes)
            columns: list[list] = [[] for _ in range(9)]
            for window, size, g in zip(windows, sizes, dealt, strict=True):
                offset, tier = 0, next(t for t in packer.tiers if t >= size)
                for k, start, n in window:
                    doc = held[k]
                    row = (doc[0], start, n, zlib.crc32(doc[1][4 * start : 4 * (start + n)]), len(doc[1]) // 4, base + count, offset, tier, step_base + groups + g)
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
                    offset += n
                    doc[2] -= n
                    if not doc[2]:
                        del held[k]
                count += 1
            groups += max(dealt, default=-1) + 1
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            names = [f.strip().split()[0] for f in SCHEMA.split(",")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in common.parts(batches, 500):
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = tool.encode(text) + end
                held[key] = [doc_id, ids, len(ids) // 4]
                packer.add(key, len(ids) // 4)
                key += 1
                fresh += len(ids) // 4
                if fresh >= ROUND:
                    yield from out(packer.round(False))
                    fresh = 0
        yield from out(packer.round(True))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
