"""Writing results: tables by partition, CSV downloads with checksums, JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_partition(rows: DataFrame, path: str, *columns: str) -> None:
    """Parquet by partition; rows of one partition are brought together first, so that it has few files. A large partition is split over several tasks."""
    rows.hint("rebalance", *columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def csv(rows: DataFrame, path: str, joiner: str = "|") -> None:
    """CSV with a header; lists as joined text."""
    flat = [F.array_join(F.col(c).cast("array<string>"), joiner).alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").csv(path, header=True)


def json_objects(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def clean(value: Column, digits: int = 4) -> Column:
    """A finite number rounded half to even, else null."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.bround(value, digits))


def columnar(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """One row of arrays, a column each, in order: for tables that are sent whole and so are small."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), *columns)))
    return rows.agg(packed.alias("_p")).select(*[F.col("_p").getField(c).alias(c) for c in columns])


def note_for(column: str, notes: dict[str, str]) -> str | None:
    """The description under the longest prefix of a column's name."""
    best = max((p for p in notes if column.startswith(p)), key=len, default=None)
    return notes.get(best) if best is not None else None


def digest_of_files(spark, path: str) -> DataFrame:
    """(path, sha256, bytes) of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
