"""Shared by operators: checkpoints, and running sums that no group's size confines to one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared folder; one of this machine only for a local session that names none.

    On a cluster without one this is an error: executors share no local folder.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="reachspark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


#: Rows that one task sorts and aggregates where ``dealt`` says so: some hundreds of MB.
ROWS_A_TASK = 1_000_000


def dealt(table: DataFrame, by: list[str], rows: int) -> DataFrame:
    """``table`` of about ``rows`` rows dealt out by ``by``, so that tasks grow in number, not in size.

    Adaptive execution fills tasks up to a compressed size, which for short rows is many
    times that in memory; it leaves a given number of partitions alone.
    """
    return table.repartition(max(-(-rows // ROWS_A_TASK), table.sparkSession.sparkContext.defaultParallelism), *by)


def running(table: DataFrame, by: list[str], order: list[str], weight: str, upto: str = "_upto", total: str = "_total") -> DataFrame:
    """Adds the sum of ``weight`` up to and with each row in order, and that of its whole group.

    Rows are dealt out by ranges of (by, order) and written; each range is summed, ranges
    are added up (a row for each range and group), and only the sum within a range is a
    window over rows. A group of any size is therefore spread over as many tasks as its
    rows fill.
    """
    dealt = checkpointed(table.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy(*by, "_range").agg(F.sum(weight).alias("_s"))
    before = F.sum("_s").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_range").alias("_r"), before.alias("_before"), F.sum("_s").over(W.partitionBy(*by)).alias(total))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    joined = dealt.join(sums, same)
    own = F.sum(weight).over(W.partitionBy(*by, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return joined.withColumn(upto, own + F.coalesce("_before", F.lit(0))).select(*table.columns, upto, total)


def numbered(table: DataFrame, by: list[str], order: list[str], name: str, total: str = "_rows") -> DataFrame:
    """Adds each row's number in its group, from 1, and how many rows the group has."""
    return running(table.withColumn("_one", F.lit(1).cast("long")), by, order, "_one", name, total).drop("_one")
