"""Nearest services, counts, standards and jobs within reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = (10, 15, 20, 30)


def nearest(pairs: DataFrame, keys: list[str], limit: int = 60) -> DataFrame:
    """Least minutes and the destination that has them; ties to the smaller id."""
    best = pairs.filter(F.col("minutes") <= limit).groupBy(*keys).agg(F.min(F.struct("minutes", "destination")).alias("best"))
    return best.select(*keys, "best.minutes", F.col("best.destination").alias("nearest_id"))


def counts_within(pairs: DataFrame, keys: list[str], limits: tuple[int, ...] = STEPS) -> DataFrame:
    """How many destinations lie within each limit."""
    return pairs.groupBy(*keys).agg(*[F.count_if(F.col("minutes") <= t).alias(f"n{t}") for t in limits])


def count_step(standard: int) -> int:
    """The largest counted step within a standard, the first if none is."""
    return max((s for s in STEPS if s <= standard), default=STEPS[0])


def by_mode(pairs: DataFrame, keys: list[str], modes: tuple[str, ...]) -> DataFrame:
    """Least minutes in a column for each mode (null: not reached)."""
    return pairs.groupBy(*keys).pivot("mode", list(modes)).agg(F.min("minutes"))


def for_every_cell(cells: DataFrame, names: list, rows: DataFrame, name: str, values: list[str]) -> DataFrame:
    """Every cell with every one of ``names``: the values of ``rows`` (cell, name, values), null where it has none.

    Cells that reach nothing stay, so that shares are of all residents. A cell's values are
    packed into a map of at most ``names`` entries before the join, which therefore moves
    each cell once, not once for each name.
    """
    packed = rows.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct(name, F.struct(*values)))).alias("_of"))
    every = cells.join(packed, "cell", "left").withColumn(name, F.explode(F.array(*[F.lit(n) for n in names])))
    return every.withColumn("_one", F.try_element_at("_of", F.col(name))).select(*[F.col(c) for c in cells.columns], name, *[F.col("_one").getField(v).alias(v) for v in values])


def standards(table: DataFrame, limit: int, modes: tuple[str, ...] = ("walk", "bike", "pt"), transit: str = "pt", foot: str = "walk") -> DataFrame:
    """best, via, meets and options of a table with minutes by mode.

    ``via`` is the mode of the best time, the first listed on ties. Transit counts as an
    option of its own only where it is strictly quicker than walking.
    """
    best = F.least(*[F.col(m) for m in modes])
    via = F.coalesce(*[F.when(F.col(m) == best, F.lit(m)) for m in modes])
    met = lambda m: F.coalesce(F.col(m) <= limit, F.lit(False))
    own = lambda m: met(m) & F.coalesce(F.col(m) < F.col(foot), F.lit(True)) if m == transit else met(m)
    options = sum((own(m).cast("int") for m in modes[1:]), own(modes[0]).cast("int"))
    return table.withColumn("best", best).withColumn("via", via).withColumn("meets", F.coalesce(best <= limit, F.lit(False))).withColumn("options", options)


def weight_within(pairs: DataFrame, weights: DataFrame, keys: list[str], limits: tuple[int, ...], name: str = "jobs") -> DataFrame:
    """Sum of the destinations' weights within each limit; ``weights`` is (destination, weight)."""
    sums = [F.sum(F.when(F.col("minutes") <= t, F.col("weight")).otherwise(0.0)).alias(f"{name}_{t}") for t in limits]
    return pairs.join(weights, "destination").groupBy(*keys).agg(*sums)


def competition_adjusted(pairs: DataFrame, weights: DataFrame, demand: DataFrame, limit: int) -> DataFrame:
    """Two-step floating catchment: (origin, access), whose demand-weighted mean over all demand is 1.

    ``demand`` is (origin, demand); origins that reach nothing count in the mean. A
    destination without competing demand has ratio 0.
    """
    near = pairs.filter(F.col("minutes") <= limit).select("origin", "destination")
    wanted = near.join(demand, "origin").groupBy("destination").agg(F.sum("demand").alias("demand"))
    supply = wanted.join(weights, "destination").select("destination", F.when(F.col("demand") > 0, F.col("weight") / F.col("demand")).otherwise(0.0).alias("ratio"))
    access = near.join(supply, "destination").groupBy("origin").agg(F.sum("ratio").alias("raw"))
    every = demand.join(access, "origin", "left").select("origin", "demand", F.coalesce("raw", F.lit(0.0)).alias("raw"))
    mean = every.agg((F.sum(F.col("raw") * F.col("demand")) / F.sum("demand")).alias("mean"))
    return every.join(F.broadcast(mean)).select("origin", F.when(F.col("mean") > 0, F.col("raw") / F.col("mean")).alias("access"))  # one row


def best_count(table: DataFrame, columns: list[str]) -> Column:
    """The greatest of several counts; nulls never win."""
    return F.greatest(*[F.col(c) for c in columns])
