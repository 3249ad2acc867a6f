"""SimHash near-duplicates with pivot distance tables.

A text's fingerprint takes the majority of the 64-bit XXH64 values of its word shingles, bit by bit.  For candidate
search every distinct fingerprint gets a table of Hamming distances to fixed reference fingerprints (pivots): some
references cover all 64 bits, others one of ``parts`` bit ranges each.  By the triangle inequality two fingerprints
within ``bits`` differ by at most ``bits`` in every coordinate, and since the differing bits leave at least
``parts - bits`` ranges alone, all coordinates of that many ranges are equal.  Pairs therefore meet in buckets of equal
range coordinates, are discarded when their largest difference over the 64-bit pivots exceeds ``bits``, and survivors
are verified by exact distance.  Nothing is missed.  ``parts`` follows the number of distinct fingerprints, so buckets
stay small; a bucket over ``BUCKET`` rows is split into block pairs, each one task's bounded work.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, local_roots, mapped, packed_row, pairs_in_runs, runs_of, unsigned_mod, written

PIVOTS = 32  # 64-bit reference fingerprints
RANGE_PIVOTS = 24  # references for each bit range
BUCKET = 4096  # rows of a bucket in one block
BIN = 16384  # rows that one call of the bucket function gets on average
SEED = 42


def fingerprint(text: str | None, words: int = 4) -> int:
    """Majority fingerprint of one text: lower-cased A-Z, ASCII white space between words, shingles of ``words``.

    Fewer words make one shingle of them all; no words (also null) give zero.  Repeated shingles count each time.
    """
    norm = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not norm:
        return 0
    blanks = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32).tolist()
    starts, ends = [0, *(b + 1 for b in blanks)], [*blanks, len(norm)]
    digest = xxhash.xxh64_intdigest
    if len(starts) <= words:
        hashes = [digest(norm, SEED)]
    else:
        hashes = [digest(norm[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])]
    h = np.array(hashes, np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        counts += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` (doc_id), fp (the fingerprint as a signed long): whole texts, one scan, no shuffle."""
    kinds = dict(docs.dtypes)

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in b.column("text")), np.uint64, b.num_rows)
            yield {c: b.column(c) for c in keys} | {"fp": fp.view(np.int64)}

    return mapped(docs.select(*keys, "text"), run, "".join(f"{c} {kinds[c]}, " for c in keys) + "fp long")


def parts_for(n: int, bits: int) -> int:
    """Bit ranges that make the least work for n distinct fingerprints: rows made against pairs compared."""
    cost = {s: comb(s, bits) * (n * 40 + n * n / 2 / 2.0 ** (64 * (s - bits) / s)) for s in range(bits + 1, bits + 5)}
    return min(cost, key=cost.get)


class PivotTables:
    """Reference fingerprints, and the distances to them."""

    def __init__(self, bits: int, parts: int):
        rng = np.random.default_rng(SEED)
        self.bits = bits
        self.pivots = rng.integers(0, 2**64, PIVOTS, np.uint64)
        edges = np.linspace(0, 64, parts + 1).round().astype(int)
        self.masks = [np.uint64(((1 << int(b - a)) - 1) << int(a)) for a, b in zip(edges, edges[1:])]
        self.range_pivots = [rng.integers(0, 2**64, RANGE_PIVOTS, np.uint64) & m for m in self.masks]
        self.tables = list(combinations(range(parts), parts - bits))

    def whole(self, fp: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fp[:, None] ^ self.pivots)

    def keys(self, fp: np.ndarray):
        """For each table the hashed coordinates of its ranges; a signed long for each fingerprint."""
        coded = []
        rng = np.random.default_rng(SEED + 1)
        for mask, pivots in zip(self.masks, self.range_pivots):
            d = np.bitwise_count((fp & mask)[:, None] ^ pivots).astype(np.uint64)
            coded.append((d * rng.integers(0, 2**64, RANGE_PIVOTS, np.uint64)).sum(1, dtype=np.uint64))
        for t, ranges in enumerate(self.tables):
            k = np.full(len(fp), np.uint64((t + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            for r in ranges:
                k = (k ^ coded[r]) * np.uint64(0xD6E8FEB86659FD93)
                k ^= k >> np.uint64(32)
            yield k.view(np.int64)

    def linked(self, fp: np.ndarray, whole: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs left after the pivot bound, pivots a few at a time, and the exact distance."""
        for k in range(0, PIVOTS, 8):
            a, b = whole[i, k : k + 8], whole[j, k : k + 8]
            near = (np.maximum(a, b) - np.minimum(a, b) <= self.bits).all(1)
            i, j = i[near], j[near]
        near = np.bitwise_count(fp[i] ^ fp[j]) <= self.bits
        return i[near], j[near]


def near_links(fps: DataFrame, bits: int = 4, parts: int | None = None) -> DataFrame:
    """(a, b) longs: links that connect every pair of distinct fingerprints ``fp`` within ``bits``, as a spanning set."""
    spark = fps.sparkSession
    n = fps.count()
    tables = PivotTables(bits, parts or parts_for(n, bits))

    def keyed(batches):
        for pdf in batches:
            for k in tables.keys(pdf.fp.to_numpy().view(np.uint64)):
                yield pd.DataFrame({"key": k, "fp": pdf.fp})

    rows = written(fps.select("fp").mapInPandas(keyed, "key long, fp long"), "simhash-buckets", n * len(tables.tables))
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    rows = rows.join(sizes, "key")
    blocks = F.ceil(F.col("size") / BUCKET).cast("int")
    rows = rows.withColumn("block", unsigned_mod(F.xxhash64("fp"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", "fp", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    bins = max(1, -(-n * len(tables.tables) // BIN))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "x", "y", "fp"], ignore_index=True)
        fp, block = pdf.fp.to_numpy().view(np.uint64), pdf.block.to_numpy()
        whole = tables.whole(fp)
        own = (pdf.x == pdf.y).to_numpy()
        root = np.arange(len(fp))
        for i, j in pairs_in_runs(runs_of(pdf.key.to_numpy(), pdf.x.to_numpy(), pdf.y.to_numpy())):
            new = own[i] | (block[i] != block[j])
            i, j = tables.linked(fp, whole, i[new], j[new])
            if len(i):
                root = local_roots(len(fp), np.concatenate([np.arange(len(fp)), i]), np.concatenate([root, j]))
        at = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"a": pdf.fp.to_numpy()[at], "b": pdf.fp.to_numpy()[root[at]]})

    group = unsigned_mod(F.xxhash64("key", "x", "y"), bins).alias("bin")
    return rows.groupBy(group).applyInPandas(compare, "a long, b long")


def grouped(distinct: DataFrame, bits: int = 4, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``distinct`` (fp, ...) with the component of each fingerprint, and the written links behind it."""
    links = written(near_links(distinct, bits, parts), "simhash-links")
    comp = components(links, "simhash-components").withColumnRenamed("node", "fp")
    return distinct.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp")), links


def simhash_components(docs: DataFrame, bits: int = 4, words: int = 4, parts: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: smallest doc_id reachable over links of at most ``bits``.

    Every row of ``docs`` comes back once.  Equal fingerprints, zero among them, are one node, so copies are never
    expanded.  Null or empty texts have fingerprint zero; a null doc_id takes its component's smallest other id, or
    null; repeated rows and ids come back as often; an empty table gives no rows; other columns are ignored.
    """
    all_fps = written(fingerprints(docs, words), "simhash-fingerprints")
    n = all_fps.count()
    distinct = written(all_fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct", n)
    nodes, links = grouped(distinct, bits, parts)
    ids = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    of = written(nodes.join(ids, "component").select("fp", "component_id"), "simhash-of", n)
    dropped(links)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return all_fps.join(of, "fp").select("doc_id", hexed, "component_id")


def deduplicated(docs: DataFrame, bits: int = 4, words: int = 4) -> DataFrame:
    """Exactly one row of ``docs`` for each near-duplicate group: the one with the smallest doc_id, null last.

    Of a group's rows with this id (a null or repeated one) the one with the least hash of the whole row stays, so
    rows with null or repeated ids are kept or dropped by their texts like any others; of equal rows one stays.  Null and
    empty texts have fingerprint zero and are one group; columns may have any names; an empty table gives no rows.
    """
    plain = lambda c, kind: F.map_entries(F.col(f"`{c}`")) if kind.startswith("map<") else F.col(f"`{c}`")
    values = [x for c, kind in docs.dtypes for x in (plain(c, kind), F.col(f"`{c}`").isNull())]  # a null alone leaves the hash as it was
    keyed = docs.select(packed_row(docs), "doc_id", "text", F.xxhash64(*values).alias("hash"))
    rows = written(fingerprints(keyed, words, ("doc_id", "hash")), "simhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "hash")).alias("least")
    distinct = written(rows.groupBy("fp").agg(first), "simhash-distinct", rows.count())
    nodes, links = grouped(distinct, bits)
    keep = nodes.groupBy("component").agg(F.min("least").alias("m")).select(F.col("m.doc_id").alias("keep"), F.col("m.hash").alias("kept"))
    keep = written(keep.distinct(), "simhash-keep")
    dropped(links)
    is_ = lambda other: keyed.doc_id.eqNullSafe(other.keep) & (keyed.hash == other.kept)
    repeated = rows.groupBy(F.col("doc_id").alias("keep"), F.col("hash").alias("kept")).count().where("count > 1").drop("count")
    repeated = written(repeated, "simhash-repeated")
    out = keyed.join(keep, is_(keep), "left_semi")
    once = out.join(repeated, is_(repeated), "left_anti").select("row")
    twice = out.join(repeated, is_(repeated), "left_semi").groupBy("doc_id", "hash").agg(F.first("row").alias("row"))  # equal rows
    return once.unionByName(twice.select("row")).select("row.*")
