"""Mixing sources to target weights.

Every document gets a hash-random key.  Within a source the keys' leading hex digits are ranges of equal expected
size, so a hot source is spread over all of them; sizes are pre-aggregated per range, ranges are prefix-summed, and a
window within each range completes the distributed prefix sum.  Each source is cut where the sum meets its budget:
whole epochs first, then documents in key order, the last one in part.  Everything is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, written

WEIGHTS = (3, 1, 2)  # by the source's place, repeating
SHARE = 1.5  # of all sizes, that the mix takes
EPOCHS = 2.0  # most that a source repeats
KEY_DIGITS = 3  # hex digits of a range: 4096 ranges
SALT = "mix"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, epochs: float = EPOCHS) -> list[float]:
    """Budgets by weight that add up to ``share`` of all sizes, none above ``epochs`` of its size; excess is dealt anew by weight."""
    out, full = [0.0] * len(sizes), set()
    rest = share * sum(sizes)
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / weight > epochs * sizes[i]]
        for i in open_:
            out[i] = rest * weights[i] / weight
        if not over:
            return out
        for i in over:
            out[i] = epochs * sizes[i]
            full.add(i)
        rest = share * sum(sizes) - sum(out[i] for i in full)


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row.

    Sources stand by code point, null last.  ``taken`` is how many of its words the mix takes, repeats counted: ``size``
    for each whole epoch, and in the last epoch what the budget leaves.  Null texts have size 0 and give nothing; rows with
    null doc_ids are keyed by their texts; repeated rows are documents of their own; an empty table gives no rows.  Per-source
    budgets (one row a source) are worked out on the driver; sources must number far fewer than documents.
    """
    return _mixed(docs, weights, share, epochs, [])


def _mixed(docs: DataFrame, weights: tuple[float, ...], share: float, epochs: float, keep: list[str]) -> DataFrame:
    """mixed(), with the columns to ``keep`` as one struct ``row``, so that no name clashes."""
    cols = ["doc_id", "source", *(["row"] if keep else [])]
    docs = docs.select("doc_id", "source", "text", *([F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")] if keep else []))
    base = docs.select(*cols, words(F.col("text")).alias("size"), F.md5(F.concat_ws("|", F.lit(SALT), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null|"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))).cast("binary")).alias("key"))
    base = base.withColumn("range", F.substring("key", 1, KEY_DIGITS))
    ranges = written(base.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    found = ranges.groupBy("source").agg(F.sum("range_size").alias("n")).collect()
    found = sorted(found, key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be", "surrogatepass")))
    goal = targets([r.n for r in found], [weights[i % len(weights)] for i in range(len(found))], share, epochs) if found else []
    spark = docs.sparkSession
    budget = spark.createDataFrame([(r.source, r.n, t) for r, t in zip(found, goal)], "s string, source_size long, target double")
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    ranges = ranges.join(budget, ranges.source.eqNullSafe(budget.s)).select(F.col("source").alias("s"), F.col("range").alias("r"), "before", "source_size", "target")
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(ranges, rows.source.eqNullSafe(ranges.s) & (rows.range == ranges.r))
    whole = F.round("target").cast("long")
    turns = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0))
    rest = whole - turns * F.col("source_size") - F.col("before") - F.col("inside")
    taken = turns * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return rows.select(*cols, "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """The mix as rows of ``docs``: a document as often as whole epochs take it, and once more cut to the words taken in part.

    Columns are those of ``docs``, whatever their names; n_chars, where there is one, follows a cut text.  Documents without
    words, null texts among them, are not in it; rows with null ids and repeated rows are documents of their own; an empty
    table gives no rows.
    """
    rows = _mixed(docs, weights, share, epochs, docs.columns).where("taken > 0")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    part = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    # at most one document a source is cut; its white space stays
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(rf"([\x20\x09-\x0D]*{WORD})"), 1), F.lit(1), part.cast("int")), "")
    text = F.when(part < F.col("size"), cut).otherwise(F.col("row.text"))
    kinds = dict(docs.dtypes)
    new = {"text": text, "n_chars": F.when(part < F.col("size"), F.char_length(cut).cast(kinds.get("n_chars", "long"))).otherwise(F.col("row.n_chars"))} if "n_chars" in kinds else {"text": text}
    return rows.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
