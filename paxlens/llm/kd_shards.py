"""K-d tree sharding: recursive splits at distributed weighted medians along the widest metadata dimension.

Documents with equal texts form one item, so copies land in one shard; only a group larger than a whole shard's share
is split into pieces.  Items have the dimensions length (logarithmic), doc_id, source and lang, each scaled to its range
over the table and extended by the item's hash, so every cut falls between two items.  Leaves are counted, or as many as
reach a target of bytes.  A node of k leaves is cut where the weight below is ``floor(k / 2) / k`` of its own: all nodes of
a level refine their cuts together with histograms that are aggregated and summed up on the executors, so the driver sees
one row a node.  The tree travels as flat arrays of dimensions and cuts; an item descends them level by level.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import constants, unsigned_mod, written

BIN_BITS = 10  # of a histogram round: 1024 bins a node
VALUE_BITS, HASH_BITS = 20, 43  # of a dimension's value, and of the hash that orders equal values
NEAR = 0.001  # a cut is close enough when its last bin holds this part of a leaf
SLOT_ROWS = 200_000  # rows of one shard numbered in one task
DIMENSIONS = ("length", "doc_id", "source", "lang")
NAME_BYTES = 6  # of a source or lang behind what all have in common, that make its value
OVERHEAD = 16  # bytes of a record beside its text


@dataclass
class Tree:
    """A binary tree in heap order (children of h: 2h + 1 and 2h + 2): dimension and cut of each node, -1 where all goes left."""

    levels: int
    dims: list[int] = field(default_factory=list)
    cuts: list[int] = field(default_factory=list)
    shards: list[int] = field(default_factory=list)  # of the last level's nodes

    def node(self, keys: list[Column], levels: int) -> Column:
        """An item's place within a level."""
        if not levels:
            return F.lit(0)
        dims, cuts, own = constants(self.dims, "int"), constants(self.cuts, "bigint"), F.array(*keys)
        right = lambda h: F.coalesce((F.get(own, F.get(dims, h)) >= F.get(cuts, h)).cast("int"), F.lit(0))
        return F.aggregate(F.array(*[F.lit(0)] * levels), F.lit(0), lambda h, _: 2 * h + 1 + right(h)) - ((1 << levels) - 1)

    def shard(self, keys: list[Column]) -> Column:
        return F.get(constants(self.shards, "int"), self.node(keys, self.levels))


def kd_tree(items: DataFrame, leaves: int) -> Tree:
    """The tree over items (weight long, k0, k1, ... longs below 2^63): about one small job a refinement round."""
    names = [c for c in items.columns if c.startswith("k")]
    keys = [F.col(c) for c in names]
    tree, sizes = Tree(max(0, leaves - 1).bit_length()), [leaves]
    for level in range(tree.levels):
        placed = items.withColumn("node", tree.node(keys, level))
        extent = (f(d).alias(f"{side}{d}") for d in names for side, f in (("lo", F.min), ("hi", F.max)))
        spread = {r.node: r for r in placed.groupBy("node").agg(F.sum("weight").alias("w"), *extent).collect()}
        dims, cuts, search = [-1] * len(sizes), [0] * len(sizes), {}
        for i, k in enumerate(sizes):
            if k > 1 and (r := spread.get(i)):
                wide = [(r[f"hi{d}"] >> HASH_BITS) - (r[f"lo{d}"] >> HASH_BITS) for d in names]
                dims[i] = wide.index(max(wide))
                lo, hi = r[f"lo{names[dims[i]]}"], r[f"hi{names[dims[i]]}"]
                search[i] = {"lo": lo, "bits": (hi - lo).bit_length(), "below": 0, "goal": r.w * (k // 2) / k, "near": NEAR * r.w / k}
        while search:
            live = [search.get(i) for i in range(len(sizes))]
            pick = lambda values, kind="bigint": F.get(constants(values, kind), F.col("node"))
            shift = [max(0, s["bits"] - BIN_BITS) if s else 0 for s in live]
            inside = placed.select("node", "weight", (F.get(F.array(*keys), pick(dims, "int")) - pick([s["lo"] if s else 0 for s in live])).alias("off"), pick([s["bits"] if s else -1 for s in live], "int").alias("bits"), pick(shift, "int").alias("shift"))
            inside = inside.where((F.col("bits") >= 0) & (F.col("off") >= 0) & (F.expr("shiftright(off, bits)") == 0))
            bins = inside.groupBy("node", F.expr("shiftright(off, shift)").alias("bin")).agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
            own = Window.partitionBy("node")
            bins = bins.withColumns({"upto": F.sum("w").over(own.orderBy("bin")), "last": F.max("bin").over(own)})
            want = pick([s["goal"] - s["below"] if s else 0.0 for s in live], "double")
            cut_bins = bins.where((F.col("upto") >= want) | (F.col("bin") == F.col("last"))).groupBy("node").agg(F.min(F.struct("bin", "w", "n", "upto")).alias("b"))
            found = {r.node: r.b for r in cut_bins.collect()}
            for i in list(search):
                s, (b, w, n, upto) = search[i], found[i]
                start, before = s["lo"] + (b << shift[i]), s["below"] + upto - w
                if shift[i] == 0 or n == 1 or w <= s["near"]:
                    over = before + w - s["goal"] > s["goal"] - before  # the nearer side of the last bin
                    cuts[i] = start if over else min(start + (1 << shift[i]), 2**63 - 1)
                    del search[i]
                else:
                    search[i] = s | {"lo": start, "bits": shift[i], "below": before}
        tree.dims += dims
        tree.cuts += cuts
        sizes = [x for i, k in enumerate(sizes) for x in ((k // 2, k - k // 2) if k > 1 and dims[i] >= 0 else (k, 0))]
    at = 0
    for k in sizes:
        tree.shards.append(at)
        at += k
    return tree


def _value(text: str | None, common: int) -> float:
    """A name as a number in code-point order of what follows the bytes all names share; null lowest."""
    return -1.0 if text is None else float(int.from_bytes(text.encode("utf-8", "surrogatepass")[common:][:NAME_BYTES].ljust(NAME_BYTES, b"\0"), "big"))


def _value_column(c: Column, common: int) -> Column:
    """As _value()."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), common + 1, NAME_BYTES)), 2 * NAME_BYTES, "0"), 16, 10).cast("double"), F.lit(-1.0))


def sharded(docs: DataFrame, shards: int = 40, law: str = "bytes", target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    ``size`` is the text's UTF-8 bytes (null: none) plus 16.  The law is ``bytes``: shards have near equal sums of sizes.
    ``target_bytes`` asks for as many shards as hold so much each, instead of a number of them.  Equal texts (also nulls, also
    empty ones) share a shard unless together they exceed a shard's share; then their ids deal them to pieces, null ids each
    on its own.  Slots number a shard's rows from 0 without gaps; grown_shard is null under this law.  Null ids, sources and
    langs sort lowest; repeated rows are rows of their own; other columns, of any name, are ignored; fewer items than shards
    leave shards empty; an empty table gives no rows.
    """
    if law != "bytes":
        raise ValueError("this operator holds the law 'bytes'")
    raw = F.col("text").cast("binary")
    has = set(docs.columns)
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
        F.md5(F.coalesce(raw, F.lit(b"\x00null"))).alias("digest"),
        F.log2(F.lit(1.0) + F.coalesce(F.char_length("text"), F.lit(0))).alias("length"),
        *((F.col(c) if c in has else F.lit(None)).cast("string").alias(c) for c in ("source", "lang")),
        F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id()).alias("own"),  # rows with null ids apart
    )
    rows = written(rows, "shard-rows")
    whole = rows.agg(F.sum("size").alias("w"), F.count("*").alias("n"), *(f(c).alias(f"{a}_{c}") for c in DIMENSIONS for a, f in (("lo", F.min), ("hi", F.max)))).first()
    if target_bytes:
        shards = max(1, -(-(whole.w or 0) // target_bytes))
    share = max(1, (whole.w or 0) // shards)
    groups = rows.groupBy("digest").agg(F.sum("size").alias("group_size"))
    large = groups.where(F.col("group_size") > share).select("digest", F.ceil(F.col("group_size") * 16 / share).cast("int").alias("pieces"))  # fewer than there are shards
    rows = rows.join(F.broadcast(large), "digest", "left").withColumn("piece", F.coalesce(unsigned_mod(F.xxhash64("own"), F.col("pieces")), F.lit(0)).cast("int")).drop("pieces")
    common = {c: len(commonprefix([(whole[f"{a}_{c}"] or "").encode("utf-8", "surrogatepass") for a in ("lo", "hi")])) for c in ("source", "lang")}

    def scaled(c: str) -> Column:
        lo, hi = whole[f"lo_{c}"], whole[f"hi_{c}"]
        if c in common:
            x, lo, hi = _value_column(F.col(c), common[c]), -1.0 if lo is None else min(_value(lo, common[c]), _value(hi, common[c])), _value(hi, common[c])
        else:
            x, lo, hi = F.col(c).cast("double"), float(lo or 0), float(hi or 0)
        value = F.coalesce((x - F.lit(lo)) / F.lit(hi - lo or 1.0), F.lit(0.0)) * ((1 << VALUE_BITS) - 1)
        value = F.least(F.greatest(value, F.lit(0.0)), F.lit(float((1 << VALUE_BITS) - 1))).cast("long")
        return F.shiftleft(value, HASH_BITS) + F.shiftrightunsigned(F.xxhash64("digest", "piece", F.lit(DIMENSIONS.index(c))), 64 - HASH_BITS)

    items = rows.groupBy("digest", "piece").agg(F.sum("size").alias("weight"), *(F.min(c).alias(c) for c in DIMENSIONS))
    items = written(items.select("digest", "piece", "weight", *(scaled(c).alias(f"k{i}") for i, c in enumerate(DIMENSIONS))), "shard-items")
    tree = kd_tree(items, shards)
    of = items.select("digest", "piece", tree.shard([F.col(f"k{i}") for i in range(len(DIMENSIONS))]).alias("shard"))
    placed = rows.join(of, ["digest", "piece"]).select("doc_id", "size", "text_crc32", "shard", "own")
    subs = max(4, -(-(whole.n or 0) // (shards * SLOT_ROWS)))
    placed = placed.withColumn("sub", unsigned_mod(F.xxhash64("own", "text_crc32"), subs).cast("int")).drop("own")
    placed = written(placed, "shard-placed")
    counts = placed.groupBy("shard", "sub").agg(F.count("*").alias("n"))  # shards x subs rows
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "size", "text_crc32"))
    out = placed.withColumn("number", number).join(counts, ["shard", "sub"])
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("before") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
