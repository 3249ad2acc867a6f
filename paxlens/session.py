"""Session helpers shared by all parts of the library."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver found it, unless it was shipped otherwise."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])
    return spark


FEW_FILES, FILE_ROWS = 8, 250_000
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one of its own only in local mode, where that is unset."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "")
        if not base:
            base = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="paxlens-")
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, and losing executors loses nothing.

    Where a bound on its ``rows`` is known, as many tasks write it as these need, so small tables are few files.
    """
    if rows is not None:
        df = df.coalesce(max(FEW_FILES, -(-rows // FILE_ROWS)))
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._paxlens_path = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Removes a table of written() that nothing reads any more."""
    if path := getattr(df, "_paxlens_path", None):
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
