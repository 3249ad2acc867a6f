"""Hierarchical multi-length packing.

Each task packs groups of about ``GROUP_TOKENS`` tokens, or ``GROUP_DOCS`` documents, as it reads, so nothing is shuffled and memory is bounded.
Within a group whole windows of long documents stand alone; every rest is routed to the smallest tier that holds it;
each tier is packed best fit first into windows of its size; gaps are filled with whole rests of shorter tiers, then
with a piece cut from one; a window full to a tier's size, a power of two, is never padded.  What no shorter rest can
fill any more is cut into powers of two.  Sequences are dealt to step groups of near equal token counts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame

from .common import mapped
from .tokens import encoder

TIERS = (4096, 2048, 1024, 512)
GROUP_TOKENS = 1 << 22
GROUP_DOCS = 1 << 16  # a group closes at so many documents, however short they are
STEP_TOKENS = 1 << 18  # tokens of a step group aimed at


class _Rests:
    """Rests by length: (length, document, start), taken by best fit."""

    def __init__(self):
        self.items: list[tuple[int, int, int]] = []

    def add(self, n: int, doc: int, start: int) -> None:
        insort(self.items, (n, doc, start))

    def fitting(self, gap: int):
        k = bisect_left(self.items, (gap + 1, -1, -1))
        return self.items.pop(k - 1) if k else None

    def longest(self):
        return self.items.pop() if self.items else None


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) pieces that hold each token of each document exactly once.

    ``tiers`` are powers of two, descending.  All sequences are full to a power of two of at most the first tier.
    """
    top = tiers[0]
    out: list[list[tuple[int, int, int]]] = []
    by_tier = {t: _Rests() for t in tiers}
    for doc, n in enumerate(lengths):
        full = n // top * top
        out += [[(doc, k, top)] for k in range(0, full, top)]
        if n - full:
            by_tier[min(t for t in tiers if t >= n - full)].add(n - full, doc, full)
    left: list[tuple[int, int, int]] = []
    for tier, shorter in ((t, tiers[k:]) for k, t in enumerate(tiers)):
        while item := by_tier[tier].longest():
            window, gap = [item], tier - item[0]
            for t in shorter:  # best fit, own tier first, then shorter ones
                while gap and (item := by_tier[t].fitting(gap)):
                    window.append(item)
                    gap -= item[0]
            for t in reversed(shorter):
                if gap and (item := by_tier[t].longest()):  # longer than the gap: cut
                    n, doc, start = item
                    window.append((gap, doc, start))
                    rest = n - gap
                    by_tier[min(x for x in tiers if x >= rest)].add(rest, doc, start + gap)
                    gap = 0
            if gap:
                left += window  # nothing shorter is left to fill it
            else:
                out.append([(doc, start, n) for n, doc, start in window])
    sequence: list[tuple[int, int, int]] = []
    total = sum(n for n, _, _ in left)
    size = top
    while total:  # powers of two, largest first
        while size > total:
            size //= 2
        gap = size
        while gap:
            n, doc, start = left.pop()
            take = min(n, gap)
            sequence.append((doc, start, take))
            if take < n:
                left.append((n - take, doc, start + take))
            gap -= take
        out.append(sequence)
        sequence, total = [], total - size
    return out


def steps(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """Step group of each sequence: longest first to the group with the fewest tokens, so groups are near equal."""
    import heapq

    groups = [(0, k) for k in range(max(1, round(sum(sizes) / step_tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        tokens, k = heapq.heappop(groups)
        out[i] = k
        heapq.heappush(groups, (tokens + sizes[i], k))
    return out


def packed(docs: DataFrame, vocabulary: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, group_tokens: int = GROUP_TOKENS, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, tier, step_group (and ids).

    Null texts count as empty (the end id alone); null and repeated doc_ids are packed like any other, row by row; very
    long documents fill several windows; an empty table gives no rows; other columns are ignored.  sequence_id and
    step_group hold the task's number in their upper bits, so they differ between tasks without a shuffle.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        made = stepped = 0
        enc = encoder(vocabulary)
        w, end = enc.dtype.itemsize, np.array([end_id], enc.dtype).tobytes()
        ids, tokens, total = [], [], 0

        def flush():
            nonlocal made, stepped
            lengths = [len(t) // w for t in tokens]
            sequences = pack(lengths, tiers)
            sizes = [sum(p[2] for p in s) for s in sequences]
            groups = steps(sizes)
            cols = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "tier", "step_group")}
            kept = []
            for k, (s, size, group) in enumerate(zip(sequences, sizes, groups)):
                offset = 0
                for doc, start, n in s:
                    part = np.frombuffer(tokens[doc], enc.dtype, n, start * w).astype("<u4")
                    if with_ids:
                        kept.append(part.astype(np.int64))
                    row = (ids[doc], start, n, zlib.crc32(part.tobytes()), lengths[doc], base + made + k, offset, size, min(t for t in tiers if t >= size), base + stepped + group)
                    for c, v in zip(cols.values(), row):
                        c.append(v)
                    offset += n
            made, stepped = made + len(sequences), stepped + max(groups, default=-1) + 1
            return cols | {"ids": kept}

        for b in batches:
            for k in range(0, b.num_rows, 256):
                part_ids, texts = (b.column(c).slice(k, 256).to_pylist() for c in ("doc_id", "text"))
                for i, t in zip(part_ids, enc.encode(texts)):
                    ids.append(i)
                    tokens.append(t + end)
                    total += len(t) // w + 1
                    if total >= group_tokens or len(ids) == GROUP_DOCS:
                        yield flush()
                        ids, tokens, total = [], [], 0
        if ids:
            yield flush()

    form = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, tier int, step_group long" + ", ids array<long>" * with_ids
    return mapped(docs.select("doc_id", "text"), run, form)
