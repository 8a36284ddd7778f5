"""Encodings of results, digests, and keeping materialised tables current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reachspark.operators.common import numbered, running


def csr(rows: DataFrame, by: list[str], cell: str, order: list, values: list[str]) -> DataFrame:
    """(by, cell, offset, n, arrays of values): compressed rows; offset counts the values of lower cells."""
    packed = F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order], *[F.col(v).alias(f"_{v}") for v in values])))
    groups = rows.groupBy(*by, cell).agg(packed.alias("_p"), F.count("*").alias("n"))
    groups = running(groups, by, [cell], "n")
    return groups.select(*by, cell, (F.col("_upto") - F.col("n")).alias("offset"), "n", *[F.col("_p").getField(f"_{v}").alias(v) for v in values])


def dictionary(rows: DataFrame, column: str) -> DataFrame:
    """(column, code): dense codes of the distinct values in order, null left out."""
    distinct = rows.select(column).filter(F.col(column).isNotNull()).distinct()
    return numbered(distinct, [], [column], "_n").select(column, (F.col("_n") - 1).alias("code"))


def members_digest(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """SHA-256 of a group's rows whatever their order.

    Row digests are gathered by their first three digits, and the digests of these 4096
    parts once more, so that no row holds a whole group.
    """
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    hashed = rows.select(*by, F.md5(row).alias("_m")).withColumn("_part", F.substring("_m", 1, 3))
    whole = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    parts = hashed.groupBy(*by, "_part").agg(whole("_m").alias("_d"), F.count("*").alias("_n"))
    return parts.groupBy(*by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_part", "_d"))), lambda x: x["_d"]), ""), 256).alias("digest"), F.sum("_n").alias("members"))


def build_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """added, removed or changed rows of two builds; equal rows are left out."""
    a = before.select(*keys, F.col(value).alias("before"), F.lit(True).alias("_a"))
    b = after.select(*keys, F.col(value).alias("after"), F.lit(True).alias("_b"))
    both = a.join(b, keys, "full")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.select(*keys, "before", "after", kind.alias("change")).filter("change is not null")


def incremental_merge(kept: DataFrame, fresh: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Rows of unchanged keys, and the fresh rows of changed ones."""
    return kept.join(changed.select(key).distinct(), key, "left_anti").unionByName(fresh)


def stable_ids(rows: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Ids of known keys stay; new keys are numbered after the greatest, in order of key."""
    joined = rows.select(key).distinct().join(previous, key, "left")
    most = previous.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("most")).first()[0]
    new = joined.filter("id is null").drop("id")
    return joined.filter("id is not null").unionByName(numbered(new, [], [key], "_n").select(key, (F.lit(most) + F.col("_n")).cast("long").alias("id")))


def tolerance(a: Column, b: Column, absolute: float, relative: float) -> Column:
    """Whether two sums agree."""
    return F.abs(a - b) <= absolute + relative * F.abs(b)


def tile_rows(rows: DataFrame, tile: list[str], origin: str, destination: str) -> DataFrame:
    """Rows of a tile in order, with their place in it and how many the origin has. A tile has a fixed number of origins."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*tile).orderBy(origin, destination))).withColumn("of_origin", F.count("*").over(W.partitionBy(*tile, origin)))


def slower(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds how many rows of a group have a greater ``value``.

    Rows are counted by value first, so the window is over a group's different values
    (whole minutes), however many rows it has.
    """
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    above = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy(value).rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    counts = counts.select(*by, value, above.alias(name))
    return rows.join(counts, [*by, value])
