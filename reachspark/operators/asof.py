"""The row in force at a time: a join by the greatest time that is not after another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reachspark.operators.common import checkpointed


def asof(left: DataFrame, right: DataFrame, on: list[str], at: str, values: list[str], ties: list[str]) -> DataFrame:
    """``left`` with the ``values`` of the row of ``right`` that agrees on ``on`` and has the greatest ``at`` not after its own.

    Of rows of ``right`` at one time the greatest by ``ties`` counts. Without a match, with
    a null key or a null time on either side, the values are null and the row of ``left``
    stays. ``values`` must not be columns of ``left``.

    Both sides are first reduced to a row for each key and time, then laid into one order
    and dealt out by ranges of it: the last match is carried within each range by a window,
    and from range to range by a table with a row for each key and range. So a key that
    holds a large part of all rows is spread over as many tasks as it fills.
    """
    known = F.col(at).isNotNull()
    for c in on:
        known = known & F.col(c).isNotNull()
    best = right.filter(known).groupBy(*on, at).agg(F.max_by(F.struct(*values), F.struct(*ties)).alias("_value"))
    asked = left.filter(known).select(*on, at).distinct()
    line = best.withColumn("_asked", F.lit(0)).unionByName(asked.withColumn("_asked", F.lit(1)), allowMissingColumns=True)
    line = checkpointed(line.repartitionByRange(*on, at, "_asked").withColumn("_range", F.spark_partition_id()))
    ends = line.groupBy(*on, "_range").agg(F.max_by("_value", F.when(F.col("_asked") == 0, F.col(at))).alias("_end"))
    ends = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(W.partitionBy(*on).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))).drop("_end")
    own = F.last("_value", ignorenulls=True).over(W.partitionBy(*on, "_range").orderBy(at, "_asked").rowsBetween(W.unboundedPreceding, 0))
    found = line.join(ends, [*on, "_range"]).withColumn("_found", F.coalesce(own, "_carried")).filter("_asked = 1")
    return left.join(found.select(*on, at, "_found"), [*on, at], "left").select(*left.columns, *[F.col(f"_found.{v}").alias(v) for v in values])
