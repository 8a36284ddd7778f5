"""Gravity scores: impedance of time, sums of weighted destinations, indices and deciles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachspark.operators.common import running


def impedance(minutes: Column, kind: str, a: float, b: float = 0.0) -> Column:
    """Weight of a destination so many minutes away, 1 at zero.

    exponential exp(-a t), gaussian exp(-a t^2), loglogistic 1 / (1 + (t / a)^b), and
    propensity: the share of trips of that length taken, level up to its peak.
    """
    t = minutes.cast("double")
    if kind == "exponential":
        return F.exp(-a * t)
    if kind == "gaussian":
        return F.exp(-a * t * t)
    if kind == "loglogistic":
        return 1 / (1 + F.pow(t / a, F.lit(b)))
    raise ValueError(f"unknown impedance: {kind}")


def propensity(minutes: Column, speed_kmh: float, coefficients: tuple[float, float, float, float], top_km: float = 30.0, points: int = 3001) -> Column:
    """Propensity by distance with logit c0 + c1 d + c2 sqrt(d) + c3 d^2, level below the peak, 1 there."""

    def at(d: float) -> float:
        c0, c1, c2, c3 = coefficients
        return 1 / (1 + math.exp(-(c0 + c1 * d + c2 * math.sqrt(d) + c3 * d * d)))

    grid = [top_km * i / (points - 1) for i in range(points)]
    peak = max(grid, key=at)
    c0, c1, c2, c3 = coefficients
    d = F.greatest(minutes.cast("double") * speed_kmh / 60, F.lit(peak))
    return 1 / (1 + F.exp(-(c0 + c1 * d + c2 * F.sqrt(d) + c3 * d * d))) / F.lit(at(peak))


def cutoff(kind: str, a: float, fallback: int) -> int:
    """Minutes beyond which a pair adds nothing of note: ln(20) / a for the exponential."""
    return min(fallback, math.ceil(math.log(20) / a)) if kind == "exponential" else fallback


def score(pairs: DataFrame, weights: DataFrame, weight_of_time: Column, keys: list[str], limit: int = 60) -> DataFrame:
    """(keys, score): weights of the destinations times the impedance of their minutes."""
    near = pairs.filter(F.col("minutes") <= limit).join(weights, "destination")
    return near.groupBy(*keys).agg(F.sum(F.col("weight") * weight_of_time).alias("score"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean over rows that have a value; null if they have no weight."""
    kept = F.when(value.isNotNull(), weight)
    return F.sum(value * weight) / F.nullif(F.sum(kept), F.lit(0.0))


def index_to_mean(table: DataFrame, value: str, weight: str, by: list[str] | None = None, of: DataFrame | None = None) -> DataFrame:
    """Adds idx: 100 times the value over the weighted mean of ``of`` (this table itself); null if that is not positive."""
    of = table if of is None else of
    if by:
        mean = of.groupBy(*by).agg(weighted_mean(F.col(value), F.col(weight)).alias("_mean"))
        joined = table.join(mean, by, "left")
    else:
        joined = table.join(F.broadcast(of.agg(weighted_mean(F.col(value), F.col(weight)).alias("_mean"))))  # one row
    return joined.withColumn("idx", F.when(F.col("_mean") > 0, 100 * F.col(value) / F.col("_mean"))).drop("_mean")


def deciles(table: DataFrame, value: str, weight: str, key: str, by: list[str]) -> DataFrame:
    """Adds decile: tenth of the cumulative weight in order of value, each row its own step; ties by key."""
    share = F.col("_upto") / F.col("_total")
    out = running(table, by, [value, key], weight)
    return out.withColumn("decile", F.least(F.lit(10), F.greatest(F.lit(1), F.ceil(F.round(share * 10, 9)))).cast("int")).drop("_upto", "_total")
