"""Choosing among schools: who may go, nearest with ties, groups that must all be served, zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def takes(sex: Column, student: str) -> Column:
    """A school for all, or for the student's own sex."""
    return (sex == "co-ed") | (sex == student)


def covers(years_from: Column, years_to: Column, low: int, high: int) -> Column:
    """Whether the years meet [low, high]; unknown years do."""
    return F.coalesce((years_from <= high) & (years_to >= low), F.lit(True))


def eligible(choice: str, student: str, stage: tuple[int, int] | None = None) -> Column:
    """Schools that a choice (all, state, zone) counts for a student and a span of years."""
    state = (F.col("kind") != "private") & (F.col("medium") == "english")
    kept = F.lit(True) if choice == "all" else state if choice == "state" else state & F.col("zoned")
    kept = kept & takes(F.col("sex"), student)
    return kept if stage is None else kept & covers(F.col("years_from"), F.col("years_to"), *stage)


def ordered_reach(reach: DataFrame, by: list[str]) -> DataFrame:
    """Adds place: order of schools by minutes, whole metres, number."""
    return reach.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("minutes", "metres", "school")))


def nearest_with_ties(reach: DataFrame, by: list[str]) -> DataFrame:
    """(by, minutes, school, ties): the first school and the others of the same minutes, in order."""
    ranked = ordered_reach(reach, by).withColumn("_r", F.rank().over(W.partitionBy(*by).orderBy("minutes"))).filter("_r = 1")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "school"))), lambda x: x["school"])
    out = ranked.groupBy(*by).agg(F.min("minutes").alias("minutes"), ordered.alias("all"))
    return out.select(*by, "minutes", F.element_at("all", 1).alias("school"), F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(0))).alias("ties"))


def slowest(value: Column, groups: int) -> Column:
    """The slowest of several groups, null if any of them has none."""
    return F.when(F.count(value) == groups, F.max(value))


def short_list(reach: DataFrame, by: list[str], masks: dict[str, Column]) -> DataFrame:
    """Rows that are nearest, ties included, among the rows of any mask."""
    keep = F.lit(False)
    for mask in masks.values():
        best = F.min(F.when(mask, F.col("minutes"))).over(W.partitionBy(*by))
        keep = keep | F.coalesce(mask & (F.col("minutes") == best), F.lit(False))
    return reach.withColumn("_keep", keep).filter("_keep").drop("_keep")


def zone_status(years: Column, dated: Column, today: Column) -> Column:
    """in_force, upcoming, no_map or unclear_years by the dates of a school's zone."""
    return F.when(dated.isNull(), "no_map").when(years.isNull(), "unclear_years").when(dated > today, "upcoming").otherwise("in_force")


def majority_set(shares: DataFrame, cell: str, zones: str, weight: str, home: str) -> DataFrame:
    """The zone set of most weight in each cell, with whether the cell is split.

    Ties: weight to 9 places, the set that holds the centre, the smaller set, the lower list.
    """
    sums = shares.groupBy(cell, zones).agg(F.round(F.sum(weight), 9).alias("w"), F.max(home).alias("home"))
    order = W.partitionBy(cell).orderBy(F.desc("w"), F.desc("home"), F.size(zones), zones)
    ranked = sums.withColumn("_k", F.row_number().over(order)).withColumn("split", F.count("*").over(W.partitionBy(cell)) > 1)
    return ranked.filter("_k = 1").select(cell, zones, "w", "split")


def name_score(name: Column, query: str) -> Column:
    """Score of a name against a query's words: whole word 3, prefix 2, part 1, start of the name 1 more; null if a word is missing."""
    words = F.split(F.lower(name), "[^a-z0-9]+")
    total = F.lit(0)
    for token in query.lower().split():
        one = F.when(F.exists(words, lambda w: w == token), 3).when(F.exists(words, lambda w: w.startswith(token)), 2).when(F.contains(F.lower(name), F.lit(token)), 1)
        total = total + one + F.when(F.lower(name).startswith(token), 1).otherwise(0)
    return total
