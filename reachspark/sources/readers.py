"""Reading the model's files: timetables, directories, records, hand-kept tables, finished runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def timetable_file(spark: SparkSession, path: str, required: list[str], optional: list[str] = ()) -> DataFrame:
    """A CSV with a header as text: the wanted columns only, trimmed names, missing optional ones null."""
    raw = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    named = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    missing = [c for c in required if c not in named.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return named.select(*[F.col(c) for c in required], *[F.col(c) if c in named.columns else F.lit(None).cast("string").alias(c) for c in optional])


def records(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents with a list of records, or of features with attributes, as rows of text; codes lose a trailing .0"""
    raw = spark.read.option("primitivesAsString", True).json(path, multiLine=True)
    if "records" in raw.columns:
        rows = raw.select(F.explode("records").alias("r")).select("r.*")
    else:
        rows = raw.select(F.explode("features").alias("f")).select("f.attributes.*")
    return rows.select(*[F.regexp_replace(F.col(f"`{c}`"), r"\.0$", "").alias(c) for c in rows.columns])


def checked(spark: SparkSession, path: str) -> DataFrame:
    """A hand-kept CSV with # comments: rows that someone has checked on a day."""
    rows = spark.read.csv(path, header=True, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return checked_rows(rows)


def checked_rows(rows: DataFrame) -> DataFrame:
    """Rows with a name and a day of who checked them when."""
    filled = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    return rows.filter(filled("checked_by") & filled("checked_on"))


def directory(spark: SparkSession, path: str) -> DataFrame:
    """A CSV as text, marks folded out of its column names, cells trimmed, blanks null."""
    from reachspark.functions.text import _MARKED, _PLAIN

    rows = spark.read.csv(path, header=True, inferSchema=False)
    fold = str.maketrans(_MARKED + _MARKED.upper(), _PLAIN + _PLAIN.upper())
    return rows.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.translate(fold).strip()) for c in rows.columns])


def finished(spark: SparkSession, path: str, manifest: str, tag: str) -> DataFrame | None:
    """Rows of one run, None unless the manifest (run_tag) has it; the filter prunes partitions."""
    done = spark.read.parquet(manifest).filter(F.col("run_tag") == tag)
    return None if done.isEmpty() else spark.read.parquet(path).filter(F.col("run_tag") == tag)


def within_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    return lon.try_cast("double").between(box[0], box[2]) & lat.try_cast("double").between(box[1], box[3])


def by_type(rows: DataFrame, kinds: dict[str, list[str]], column: str) -> DataFrame:
    """A row for each service whose list has the row's type."""
    inverted = F.create_map(*[x for kind in sorted({k for v in kinds.values() for k in v}) for x in (F.lit(kind), F.array(*[F.lit(s) for s, v in kinds.items() if kind in v]))])
    return rows.withColumn("service", F.explode(F.try_element_at(inverted, F.col(column))))


def overrides(rows: DataFrame, table: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Checked values in place of the rows' own; ``table`` is (key, field, value), hand-kept and so small."""
    kept = table.groupBy(key).pivot("field", fields).agg(F.max("value"))
    joined = rows.join(kept.select(key, *[F.col(f).alias(f"_{f}") for f in fields]), key, "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])


def entrances(schools: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """A row for each entrance of a school, or for its one point."""
    lists = table.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("_e"))
    own = F.array(F.struct(F.lit(0).alias("pos"), F.col("lon"), F.col("lat")))
    return schools.join(lists, key, "left").withColumn("_p", F.explode(F.coalesce("_e", own))).select(key, F.col("_p.pos").alias("pos"), F.col("_p.lon").alias("lon"), F.col("_p.lat").alias("lat"))
