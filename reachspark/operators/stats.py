"""Weighted statistics over cells: shares, quantiles, Palma, concentration, shortfalls, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reachspark.operators.common import running


def share(flag: Column, weight: Column) -> Column:
    """Weight of flagged rows over all weight; null without weight."""
    return F.sum(F.when(flag, weight).otherwise(0.0)) / F.nullif(F.sum(weight), F.lit(0.0))


def enough(weight: Column, value: Column, least: float = 100.0) -> Column:
    """``value`` only where the group has at least so much weight."""
    return F.when(F.sum(weight) >= least, value)


def cumulative(table: DataFrame, value: str, weight: str, key: str, by: list[str]) -> DataFrame:
    """Rows with a value and weight, in order of value then key, with cum: their share of the weight up to them."""
    rows = table.filter(F.col(value).isNotNull() & (F.col(weight) > 0))
    return running(rows, by, [value, key], weight).withColumn("cum", F.round(F.col("_upto") / F.col("_total"), 9)).drop("_upto", "_total")


def _of_values(table: DataFrame, value: str, weight: str, by: list[str], descending: bool = False) -> DataFrame:
    """(by, value, _peers, _upto, _total): each distinct value once, with the weight that has it and that up to it."""
    sums = table.groupBy(*by, value).agg(F.sum(weight).alias("_peers"))
    if not descending:
        return running(sums, by, [value], "_peers")
    turned = running(sums.withColumn("_turned", -F.col(value)), by, ["_turned"], "_peers")
    return turned.drop("_turned")


def quantile(table: DataFrame, value: str, weight: str, key: str, by: list[str], q: float = 0.5, name: str = "q") -> DataFrame:
    """The first value whose cumulative share reaches q."""
    return cumulative(table, value, weight, key, by).filter(F.col("cum") >= q).groupBy(*by).agg(F.min(value).alias(name))


def palma(table: DataFrame, value: str, weight: str, key: str, by: list[str]) -> DataFrame:
    """Weighted mean of the top tenth over that of the bottom four tenths; null if the latter is zero or empty."""
    c = cumulative(table, value, weight, key, by)
    mean = lambda keep: F.sum(F.when(keep, F.col(value) * F.col(weight))) / F.sum(F.when(keep, F.col(weight)))
    low, high = mean(F.col("cum") <= 0.4), mean(F.col("cum") > 0.9)
    return c.groupBy(*by).agg(low.alias("low"), high.alias("high"), (F.sum(F.when(F.col("cum") <= 0.4, F.col(value) * F.col(weight))) == 0).alias("least_have_nothing")).withColumn("palma", F.col("high") / F.nullif(F.col("low"), F.lit(0.0)))


def tied_bands(table: DataFrame, value: str, weight: str, by: list[str], bands: int = 10) -> DataFrame:
    """Adds band (0-based): ties share the band of their group's midpoint."""
    middle = (F.col("_upto") - F.col("_peers") / 2) / F.col("_total")
    band = F.least(F.lit(bands - 1), F.greatest(F.lit(0), F.floor(bands * middle - 1e-9))).cast("int").alias("band")
    return table.join(_of_values(table, value, weight, by).select(*by, value, band), [*by, value])


def below(table: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    """Adds below: the share of weight with a strictly smaller value."""
    less = ((F.col("_upto") - F.col("_peers")) / F.col("_total")).alias("below")
    return table.join(_of_values(table, value, weight, by).select(*by, value, less), [*by, value])


def concentration(table: DataFrame, value: str, weight: str, rank: str, by: list[str]) -> DataFrame:
    """Concentration index of ``value`` by ``rank`` descending, with tie midpoints: 2 cov(value, rank) / mean."""
    rows = table.filter(F.col(value).isNotNull() & F.col(rank).isNotNull() & (F.col(weight) > 0))
    middle = ((F.col("_upto") - F.col("_peers") / 2) / F.col("_total")).alias("_r")
    rows = rows.join(_of_values(rows, rank, weight, by, descending=True).select(*by, rank, middle), [*by, rank])
    w, v, r = F.col(weight), F.col(value), F.col("_r")
    sums = rows.groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * v).alias("wv"), F.sum(w * r).alias("wr"), F.sum(w * v * r).alias("wvr"))
    return sums.select(*by, F.when(F.col("wv") != 0, 2 * (F.col("wvr") / F.col("w") - F.col("wv") / F.col("w") * F.col("wr") / F.col("w")) / (F.col("wv") / F.col("w"))).alias("concentration"))


def shortfall(minutes: Column, standard: float, unreachable: float = 60.0) -> Column:
    """How far beyond the standard, relative to it; not reached counts as the limit, a minute beyond at least."""
    late = F.coalesce(minutes.cast("double"), F.greatest(F.lit(unreachable), F.lit(standard + 1.0)))
    return F.greatest(F.lit(0.0), (late - standard) / standard)


def fgt(gap: Column, weight: Column, standard: float) -> list[Column]:
    """Rate, depth, severity of shortfalls, and mean minutes short of those who are short."""
    total = F.nullif(F.sum(weight), F.lit(0.0))
    poor = F.sum(F.when(gap > 0, weight).otherwise(0.0))
    return [
        (poor / total).alias("rate"), (F.sum(weight * gap) / total).alias("depth"), (F.sum(weight * gap * gap) / total).alias("severity"),
        (F.sum(weight * gap) * standard / F.nullif(poor, F.lit(0.0))).alias("minutes_short"),
    ]


def average_rank(table: DataFrame, column: str) -> Column:
    """Rank in which ties have the mean of their places."""
    return F.rank().over(W.orderBy(column)) + (F.count("*").over(W.partitionBy(column)) - 1) / 2


def spearman(table: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation over a table of areas (one row each, so bounded by their number)."""
    rows = table.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return rows.select(average_rank(rows, a).alias("ra"), average_rank(rows, b).alias("rb")).agg(F.corr("ra", "rb").alias("rho"), F.count("*").alias("areas"))
