"""Connected components, pair enumeration and reading for the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import dropped, importable, new_dir, shared_dir, written

__all__ = ["WORD", "components", "constants", "crc_of_id", "dropped", "id_key", "local_roots", "mapped", "new_dir", "packed_row", "pairs_in_runs", "range_cuts", "read", "run_of", "runs_of", "shared_dir", "text_column", "texts_of", "unsigned_mod", "written"]

WORD = r"[^\x20\x09-\x0D]+"  # a word: a run of anything but the six ASCII white-space characters


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def mapped(df: DataFrame, run, form) -> DataFrame:
    """mapInArrow for functions that yield columns: ``run`` gets record batches and yields dicts in the order of ``form`` (DDL or a struct).

    Ids stay exact 64-bit integers also beside nulls, which pandas would turn into floats.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(form) if isinstance(form, str) else form)

    def convert(batches):
        for cols in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(convert, form)


def packed_row(df: DataFrame, columns: list[str] | tuple[str, ...] | None = None) -> Column:
    """All columns (or some) as one struct ``row``: beside it, columns of any name can be added."""
    return F.struct(*(F.col(f"`{c}`") for c in (df.columns if columns is None else columns))).alias("row")


def text_column(docs: DataFrame, columns: tuple[str, ...] | None) -> list[Column]:
    """The text beside packed_row(), unless that holds it: texts travel once."""
    return [] if "text" in (docs.columns if columns is None else columns) else [F.col("text").alias("t")]


def texts_of(batch):
    """The texts of a batch made by packed_row() and text_column()."""
    return batch.column("t") if "t" in batch.schema.names else batch.column("row").field("text")


def constants(values: list, kind: str) -> Column:
    """Numbers or plain words as a literal array: one leaf of the plan, however many they are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def id_key(column: str) -> Column:
    """A long as text in the same order, null first."""
    return F.when(F.col(column).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.lpad(F.hex(F.col(column).cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")))


def range_cuts(weights: DataFrame, target) -> list[str]:
    """Keys that cut rows of ``weights`` (key string, weight long) into runs of near ``target(sum of weights)``, ascending.

    The cuts follow from the rows alone, not from their partitions nor from a sample: rows are dealt to ranges (whichever
    bounds those have), range sums are accumulated, and a row belongs to the run that the weight before it says.  A key is
    never cut; the driver holds one key a run.
    """
    n, whole = weights.agg(F.count("*"), F.sum("weight")).first()
    if not n:
        return []
    ranges = max(weights.sparkSession.sparkContext.defaultParallelism, -(-n // 500_000))
    placed = written(weights.repartitionByRange(int(ranges), "key").withColumn("range", F.spark_partition_id()), "range-keys")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = placed.groupBy("range").agg(F.sum("weight").alias("w")).select("range", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("range").orderBy("key", "weight").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("inside", F.coalesce(F.sum("weight").over(inside), F.lit(0))).join(sums, "range")
    runs = at.groupBy(F.floor((F.col("before") + F.col("inside")) / F.lit(max(1, int(target(whole or 0))))).alias("run")).agg(F.min("key").alias("key")).collect()
    dropped(placed)
    return sorted({r.key for r in runs if r.run > 0})


def run_of(key: Column, cuts: list[str]) -> Column:
    """The number of cuts at or below a key, by binary search in a literal array."""
    if not cuts:
        return F.lit(0)
    table = constants(cuts, "string")
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(table, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at))


def unsigned_mod(x: Column, n: Column | int) -> Column:
    return F.pmod(x, n if isinstance(n, Column) else F.lit(int(n)))


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of an id written as text, as the train and held-out splits use it."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a long, b long), for all nodes with an edge.

    Alternates large-star and small-star: rounds grow with the logarithm of the longest path, every table holds at
    most one row per edge, and minima are pre-aggregated.  The edges of a hub meet its one minimum in a join that
    adaptive execution splits by size.  Loops and nulls are dropped; no edges give no rows.
    """
    spark = edges.sparkSession
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    now = written(edges.where("a <> b").select(hi.alias("hi"), lo.alias("lo")).distinct(), name)
    mark, n = None, now.count()
    for _ in range(most_rounds):
        both = now.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionAll(now.select("lo", "hi"))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("s"))
        large = both.where("m > n").join(least, "n").select(F.col("m").alias("hi"), F.col("s").alias("lo")).distinct()
        tops = large.groupBy("hi").agg(F.min("lo").alias("s"))
        small = large.join(tops, "hi").where("lo <> s").select(F.col("lo").alias("hi"), F.col("s").alias("lo"))
        new = written(small.unionAll(tops.select("hi", "s")).distinct(), name, 2 * n)
        got = new.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        dropped(now)
        now = new
        if tuple(got) == mark:
            break
        mark = tuple(got)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    tops = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return tops.unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n rows over the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        m = np.minimum(label[i], label[j])
        old = label.copy()
        np.minimum.at(label, i, m)
        np.minimum.at(label, j, m)
        label = label[label]
        if np.array_equal(label, old):
            break
    return label


def runs_of(*keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys in sorted columns, and the end of all."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def pairs_in_runs(bounds: np.ndarray, most: int = 1 << 17):
    """Yields index pairs (i < j) of rows that share a run, about ``most`` at a time: memory stays bounded."""
    sizes = np.diff(bounds)
    rows = np.arange(bounds[-1])
    left = np.repeat(bounds[1:], sizes) - rows - 1
    rows, left = rows[left > 0], left[left > 0]
    total = np.cumsum(left)
    at = 0
    while at < len(rows):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, "right")))
        c = left[at:to]
        i = np.repeat(rows[at:to], c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        yield i, j
        at = to
