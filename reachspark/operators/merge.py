"""Merging travel times of one pair: modes, windows, entrances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A rounding nudge that keeps exact products on their integer.
NUDGE = 1e-9


def walk_minutes(minutes: Column, factor: float) -> Column:
    """Whole minutes at another pace: down, after a nudge."""
    return F.floor(minutes * F.lit(factor) + NUDGE).cast("int")


def merge_walk(transit: DataFrame, walk: DataFrame, keys: list[str], limit: int, factor: float = 1.0, spread: bool = False) -> DataFrame:
    """All pairs that transit or walking reaches within ``limit``: minutes, r5 (transit's), walk, walk_quicker[, lo, hi].

    Equal times count as walked. Null is "not reached" and never wins. With ``spread``
    the order statistics of transit are merged with the walk, which has none.
    """
    on_foot = walk.select(*keys, walk_minutes(F.col("minutes"), factor).alias("walk")).filter(F.col("walk") <= limit)
    extra = ["lo", "hi"] if spread else []
    ride = transit.filter(F.col("minutes") <= limit).select(*keys, F.col("minutes").alias("r5"), *extra)
    both = ride.join(on_foot, keys, "full")
    quicker = F.col("walk").isNotNull() & ~F.coalesce(F.col("r5") < F.col("walk"), F.lit(False))
    out = [*keys, F.least("r5", "walk").alias("minutes"), "r5", "walk", quicker.alias("walk_quicker")]
    if spread:
        out += [F.least("lo", "walk").alias("lo"), F.least("hi", "walk").alias("hi")]
    return both.select(*out)


def merge_nearest(table: DataFrame, factor: float = 1.0, limit: int = 60) -> DataFrame:
    """Columns r5, r5_id, walk, walk_id become minutes and nearest_id: the walk only where strictly quicker or alone."""
    walk = walk_minutes(F.col("walk"), factor)
    walk = F.when(walk <= limit, walk)
    foot = walk.isNotNull() & (F.col("r5").isNull() | (walk < F.col("r5")))
    return table.withColumn("minutes", F.when(foot, walk).otherwise(F.col("r5"))).withColumn("nearest_id", F.when(foot, F.col("walk_id")).otherwise(F.col("r5_id")))


def catchment(pairs: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Least minutes of each pair over two sets of pairs."""
    return pairs.select(*keys, "minutes").unionByName(others.select(*keys, "minutes")).groupBy(*keys).agg(F.min("minutes").alias("minutes"))


def collapse(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order, as of the fastest of several entrances."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def fastest_mode(pairs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Mode and minutes of least minutes; ties go to the mode listed first."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("mode")).cast("int")
    return pairs.groupBy(*keys).agg(F.min(F.struct("minutes", place.alias("place"), "mode")).alias("best")).select(*keys, "best.minutes", "best.mode")
