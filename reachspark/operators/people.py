"""Residents: suppressed counts, age bands, spreading over pieces, shares, income."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def count(value: Column) -> Column:
    """A census count; negative codes and text mean suppressed."""
    n = value.cast("string").try_cast("double")
    return F.when(n >= 0, n)


def share(part: Column, total: Column) -> Column:
    """part over total in [0, 1]; null without a total."""
    return F.when(total > 0, F.least(F.greatest(part / total, F.lit(0.0)), F.lit(1.0)))


def fill_bands(blocks: DataFrame, bands: list[str], area: str, residents: str) -> DataFrame:
    """Suppressed bands from the area's share of residents, else from the whole table's."""
    known = lambda b: F.sum(F.when(F.col(b).isNotNull(), F.col(b))) / F.nullif(F.sum(F.when(F.col(b).isNotNull(), F.col(residents))), F.lit(0.0))
    areas = blocks.groupBy(F.col(area).alias("_area")).agg(*[known(b).alias(f"_{b}") for b in bands])
    per = blocks.join(areas, F.col(area).eqNullSafe(F.col("_area"))).drop("_area")
    # the ratio of the whole table is one row, joined, not a window over one partition
    whole = blocks.agg(*[known(b).alias(f"_all_{b}") for b in bands])
    per = per.join(F.broadcast(whole))
    for b in bands:
        per = per.withColumn(b, F.coalesce(F.col(b), F.col(residents) * F.col(f"_{b}"), F.col(residents) * F.col(f"_all_{b}")))
    return per.drop(*[f"_{b}" for b in bands], *[f"_all_{b}" for b in bands])


def regroup(fractions: dict[str, dict[str, float]]) -> list[Column]:
    """Age groups as sums of fractions of bands."""
    return [sum((F.col(b) * f for b, f in parts.items()), F.lit(0.0)).alias(group) for group, parts in fractions.items()]


def spread(pieces: DataFrame, values: DataFrame, key: str, cell: str, columns: list[str]) -> DataFrame:
    """Values of blocks over cells by each piece's share of its block's area (columns ``key``, ``cell``, area)."""
    part = pieces.withColumn("_s", F.col("area") / F.nullif(F.sum("area").over(W.partitionBy(key)), F.lit(0.0)))
    return part.join(values, key).groupBy(cell).agg(*[F.sum(F.col(c) * F.col("_s")).alias(c) for c in columns])


def to_grid(cells: DataFrame, children: str, residents: str, grid: str) -> Column:
    """Children of a cell: its own share of the grid's people; where no residents are known, the place's share."""
    own = F.col(children) / F.col(residents)
    return F.when(F.col(residents) > 0, own * F.col(grid)).otherwise(F.col("place_share") * F.col(grid))


def urban(rows: DataFrame, name: str, people: str, rural: str, least: float = 1000.0) -> DataFrame:
    """Adds urban: whether a row's area is not named as rural and has people enough."""
    areas = rows.groupBy(F.col(name).alias("_area")).agg((F.sum(people) >= least).alias("_enough"))
    return rows.join(areas, F.col(name).eqNullSafe(F.col("_area"))).withColumn("urban", ~F.col(name).rlike(rural) & F.col("_enough")).drop("_area", "_enough")


def equivalised(income: Column, size: Column, uplift: float) -> Column:
    """Income for a household of its size; null under one person or without income."""
    return F.when((size >= 1) & (income > 0), income * uplift / F.sqrt(size))


def whole_parts(rows: DataFrame, by: list[str], key: str, value: str, total: str) -> DataFrame:
    """Adds whole: integers that sum to ``total``, by largest remainders; ties to the lower key."""
    low = F.floor(F.round(F.col(value), 9))
    rest = F.round(F.col(value) - low, 9)
    left = F.round(F.col(total)).cast("long") - F.sum(low).over(W.partitionBy(*by))
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("_rest"), key))
    rows = rows.withColumn("_low", low).withColumn("_rest", rest).withColumn("_left", left)
    return rows.withColumn("whole", (F.col("_low") + F.when(place <= F.col("_left"), 1).otherwise(0)).cast("long")).drop("_low", "_rest", "_left")
