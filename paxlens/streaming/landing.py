"""Continuous analysis of source files that land in a folder: an optional extra beside the batch plan.

New package files become trees and graphs as they arrive; per-package features need the whole package, so they are made
by the batch plan from the tables written here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import callgraph, jsparse
from ..schemas import SOURCE_FILES
from ..session import importable


def source_stream(spark: SparkSession, folder: str) -> DataFrame:
    """SOURCE_FILES as JSON lines or Parquet rows landing in a folder."""
    return importable(spark).readStream.schema(SOURCE_FILES).parquet(folder)


def graph_stream(files: DataFrame) -> DataFrame:
    """One graph row for each script that arrives; stateless, so late and repeated files need no watermark."""
    return callgraph.graphs(jsparse.parse_files(files.where(F.col("rel_path").rlike(r"\.[cm]?js$"))))


def write_graphs(graphs: DataFrame, out: str, checkpoint: str):
    """Appends graph rows with exactly-once file commits; stops when everything that is there was read."""
    return graphs.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
