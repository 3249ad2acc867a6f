"""Scans of package trees: ``<root>/{malicious,benign}/<package>/...`` (classified) or ``<root>/<package>/...`` (direct)."""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..operators.jsparse import MOST_BYTES
from ..session import importable

TYPES = ("malicious", "benign")
SCRIPT = r"\.[cm]?js$"


def _parts(root: str, classified: bool) -> dict[str, Column]:
    """package_id, data_type and rel_path from a file's path."""
    tail = F.substring_index(F.col("path"), root.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    rel = F.regexp_extract("path", rf"{_escaped(root)}/+(.*)$", 1)
    rel = F.when(rel != "", rel).otherwise(tail)
    if classified:
        return {"data_type": F.regexp_extract(rel, r"^([^/]+)/", 1), "package_id": F.regexp_extract(rel, r"^[^/]+/([^/]+)/", 1), "rel_path": F.regexp_extract(rel, r"^[^/]+/[^/]+/(.*)$", 1)}
    return {"data_type": F.lit("unknown"), "package_id": F.regexp_extract(rel, r"^([^/]+)/", 1), "rel_path": F.regexp_extract(rel, r"^[^/]+/(.*)$", 1)}


def _escaped(root: str) -> str:
    from urllib.parse import urlparse

    path = urlparse(root).path or root
    return "".join("\\" + c if not c.isalnum() and c not in "/_-" else c for c in path.rstrip("/"))


def listing(spark: SparkSession, root: str, classified: bool = True, name: str | None = None) -> DataFrame:
    """Files without their content: package_id, data_type, rel_path, size.  The content column is pruned from the scan."""
    reader = importable(spark).read.format("binaryFile").option("recursiveFileLookup", True)
    if name:
        reader = reader.option("pathGlobFilter", name)
    out = reader.load(root).select(F.col("length").alias("size"), *(c.alias(n) for n, c in _parts(root, classified).items()), "path")
    if classified:
        out = out.where(F.col("data_type").isin(*TYPES))
    return out.where("package_id <> '' and rel_path <> ''")


def folders(spark: SparkSession, root: str, classified: bool = True) -> DataFrame:
    """package_id, data_type of every package folder, also of empty ones; a missing type folder is a warning.

    Names of folders only, which are fewer than the files whose names every file scan holds on the driver.
    """
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for kind in TYPES if classified else ("unknown",):
        at = jvm.org.apache.hadoop.fs.Path(base, kind) if classified else base
        if not fs.exists(at):
            warnings.warn(f"there is no folder {at.toString()}", stacklevel=2)
            continue
        found += [(x.getPath().getName(), kind) for x in fs.listStatus(at) if x.isDirectory()]
    return importable(spark).createDataFrame(found, "package_id string, data_type string")


def packages(spark: SparkSession, root: str, classified: bool = True, empty: bool = True) -> DataFrame:
    """package_id, data_type of every package; without ``empty`` only of those that hold a file, which needs no listing."""
    found = folders(spark, root, classified) if empty else listing(spark, root, classified).select("package_id", "data_type")
    return found.distinct()


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """UTF-8 without the bytes that aren't."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def source_files(spark: SparkSession, root: str, classified: bool = True, pattern: str = SCRIPT + r"|(^|/)package\.json$") -> DataFrame:
    """SOURCE_FILES: scripts (node_modules included) and package.json; files above the size limit come without code."""
    reader = importable(spark).read.format("binaryFile").option("recursiveFileLookup", True)
    parts = _parts(root, classified)
    out = reader.load(root).withColumns(parts).where((F.col("package_id") != "") & F.col("rel_path").rlike(pattern))
    if classified:
        out = out.where(F.col("data_type").isin(*TYPES))
    return out.select("package_id", "data_type", "rel_path", F.col("length").alias("size"), decoded(F.when(F.col("length") <= MOST_BYTES, F.col("content"))).alias("code"))


def scripts_only(files: DataFrame, node_modules: bool = True) -> DataFrame:
    """Script files; preprocessing leaves node_modules out, parsing doesn't."""
    out = files.where(F.col("rel_path").rlike(SCRIPT))
    return out if node_modules else out.where(F.col("rel_path").endswith(".js") & ~F.col("rel_path").rlike(r"(^|/)node_modules/"))


def targets(files: DataFrame, data_type: str = "both", only: list[str] | None = None, limit: int = -1) -> DataFrame:
    """Files to process: one data type or both, some packages or all, benign first, at most ``limit`` files."""
    if data_type != "both":
        files = files.where(F.col("data_type") == data_type)
    if only:
        files = files.where(F.col("package_id").isin(only))
    return files.orderBy("data_type", "package_id", "rel_path").limit(limit) if limit >= 0 else files


def sampled(found: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n packages in hash-random order, the same ones each time."""
    return found.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), "package_id").cast("binary")), "package_id").limit(n)


def first(found: DataFrame, n: int) -> DataFrame:
    return found.orderBy("package_id").limit(n)


def preview(files: DataFrame) -> DataFrame:
    """Per data_type: packages and script files, without processing them."""
    return files.groupBy("data_type").agg(F.countDistinct("package_id").alias("packages"), F.count_if(F.col("rel_path").rlike(SCRIPT)).alias("scripts"))


def package_name(path: Column) -> Column:
    """The path component after the first data type, else unknown_package."""
    name = F.regexp_extract(path, r"(?:^|/)(?:benign|malicious)/([^/]+)", 1)
    return F.when(name != "", name).otherwise(F.lit("unknown_package"))


def sample_code(files: DataFrame, most_chars: int = 4000, virtual: str = "_virtual_behavior_script.js") -> DataFrame:
    """package_id, code: the virtual script, then the ``.js`` files of ``package/`` or else of all, each under a header, cut to ``most_chars``.

    Without a ``package/`` folder the virtual script stands there twice, once as itself and once among the files.
    """
    js = files.where(F.col("rel_path").endswith(".js")).withColumn("text", F.regexp_replace("code", r"(?U)^\s+|\s+$", "")).where("text <> ''")
    inner = F.max(F.col("rel_path").startswith("package/")).over(Window.partitionBy("package_id"))
    name = F.element_at(F.split("rel_path", "/"), -1)
    folder = F.regexp_extract("rel_path", r"^(.*?)[^/]*$", 1)
    js = js.withColumns({"inner": inner, "name": name, "folder": folder})
    head = js.where(F.col("rel_path") == virtual).select("package_id", F.lit(0).alias("turn"), "folder", "name", "text")
    body = js.where(~F.col("inner") | F.col("rel_path").startswith("package/")).select("package_id", F.lit(1).alias("turn"), "folder", "name", "text")
    parts = head.unionAll(body).withColumn("part", F.concat(F.lit("// === "), F.col("name"), F.lit(" ===\n"), F.substring("text", 1, most_chars)))
    before = Window.partitionBy("package_id").orderBy("turn", "folder", "name", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum(F.length("part") + 2).over(before), F.lit(0))).where(F.col("before") - 2 < most_chars)  # no more than can be seen, and the blank line before a part is seen first
    ordered = F.array_sort(F.collect_list(F.struct("turn", "folder", "name", "part")))
    return parts.groupBy("package_id").agg(F.substring(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n"), 1, most_chars).alias("code"))
