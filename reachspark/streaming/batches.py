"""Resumable materialisation: batches of origins, a manifest of scopes, and what is stale.

The model has no streams. What it has instead are batches that are worked off once and
found again: a batch is done when the manifest has it under the current scope digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def assign(origins: DataFrame, key: str, size: int) -> DataFrame:
    """Adds batch: ranges of so many keys."""
    return origins.withColumn("batch", F.floor(F.col(key) / size).cast("long"))


def shard(batches: DataFrame, i: int, n: int) -> DataFrame:
    """Every n-th batch, from the i-th."""
    return batches.filter(F.pmod("batch", F.lit(n)) == i)


def stale(batches: DataFrame, manifest: DataFrame, scope: str) -> DataFrame:
    """Batches that the manifest (batch, scope) does not have under this scope."""
    return batches.join(manifest.filter(F.col("scope") == scope).select("batch"), "batch", "left_anti")


def write(rows: DataFrame, path: str) -> None:
    """Write batches by dynamic partition overwrite, so that a repeated batch replaces itself only.

    A folder a batch, which any reader can read. The driver makes and moves folders one by
    one, so this is for some hundreds of batches; ``add`` takes any number.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def add(rows: DataFrame, done: DataFrame, path: str) -> None:
    """Write ``rows`` (batch, ...) of the batches ``done`` (batch, scope) as one more version; what these batches had before counts no more.

    A version has as many files as tasks wrote it, however many batches it holds, and none
    of earlier versions is touched. Its manifest is written last: one that was stopped
    before doesn't count, and the next takes its place.
    """
    version = max(_versions(rows.sparkSession, path), default=-1) + 1
    rows.sortWithinPartitions("batch").write.mode("overwrite").parquet(f"{path}/rows/version={version}")
    done.select("batch", "scope").write.mode("overwrite").parquet(f"{path}/manifest/version={version}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(batch, scope, version): what each batch was written under last."""
    found = spark.read.schema("batch long, scope string, version int").option("basePath", f"{path}/manifest")
    listed = found.parquet(*[f"{path}/manifest/version={v}" for v in _versions(spark, path)])
    return listed.groupBy("batch").agg(F.max(F.struct("version", "scope")).alias("_last")).select("batch", "_last.scope", "_last.version")


def current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows in force, with the columns of ``schema``, which has batch: those of each batch's last version."""
    found = spark.read.schema(f"{schema}, version int").option("basePath", f"{path}/rows")
    rows = found.parquet(*[f"{path}/rows/version={v}" for v in _versions(spark, path)])
    return rows.join(manifest(spark, path).select("batch", "version"), ["batch", "version"]).select(*[c for c in rows.columns if c != "version"])


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose manifest is complete."""
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest{name}")
    fs = at("").getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(at(""))] if fs.exists(at("")) else []
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and fs.exists(at(f"/{n}/_SUCCESS")))
