"""Places by their names, exactly or by their first words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachspark.functions.text import fold_name


def place_by_name(labels: DataFrame, places: DataFrame, label: str, name: str, most: int = 4) -> DataFrame:
    """Labels with the mean point (px, py) of the places of that name, and how many; labels that find none are left out.

    Names are compared folded. A label that is nobody's whole name takes the places whose
    name begins with its words ("Henderson": "Henderson North" and "Henderson South"),
    unless these are more than ``most``; a whole name takes all of its places. Every
    beginning of whole words of a name is a key of the index, so both steps are equi-joins.
    An empty or null name matches nothing.
    """
    points = places.select(fold_name(F.col(name)).alias("_name"), F.col("x").alias("_x"), F.col("y").alias("_y")).filter("_name != ''")
    index = points.groupBy("_name").agg(F.count("*").alias("_n"), F.sum("_x").alias("_x"), F.sum("_y").alias("_y"))
    words = F.split("_name", " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.struct(F.array_join(F.slice(words, 1, k), " ").alias("key"), (k == F.size(words)).alias("whole")))
    index = index.select(F.explode(starts).alias("_k"), "_n", "_x", "_y").groupBy("_k.key").agg(
        *[F.sum(F.when(F.col("_k.whole") == w, F.col(c))).alias(f"{c}_{s}") for w, s in ((True, "whole"), (False, "start")) for c in ("_n", "_x", "_y")]
    )
    whole = F.col("_n_whole").isNotNull()
    of = lambda c: F.when(whole, F.col(f"{c}_whole")).otherwise(F.col(f"{c}_start"))
    found = labels.withColumn("_key", fold_name(F.col(label))).filter("_key != ''").join(index, F.col("_key") == F.col("key"))
    return found.filter(whole | (F.col("_n_start") <= most)).select(*labels.columns, (of("_x") / of("_n")).alias("px"), (of("_y") / of("_n")).alias("py"), of("_n").alias("places"))
