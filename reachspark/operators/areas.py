"""Why a standard is missed, and areas that are worst served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reachspark.operators.common import numbered

#: Codes: met, nothing known, and why not, in the order in which they are tried.
MET, UNKNOWN = 0, 9


def diagnose(best: Column, standard: int, near: list[tuple[Column, int]], people: Column | None = None) -> Column:
    """0 where the standard is met, else the code of the first condition that holds, 9 if none does."""
    out = F.when(F.coalesce(best <= standard, F.lit(False)), MET)
    for condition, code in near:
        out = out.when(F.coalesce(condition, F.lit(False)), code)
    return out.otherwise(UNKNOWN).cast("int")


def modal_reason(table: DataFrame, by: list[str], reason: str, weight: str) -> DataFrame:
    """(by, reason): the reason of most people, other than met and unknown; ties to the lower code, 0 if there is none."""
    sums = table.groupBy(*by, reason).agg(F.sum(weight).alias("_w"))
    counted = F.when(~F.col(reason).isin(MET, UNKNOWN) & (F.col("_w") > 0), F.struct("_w", (-F.col(reason)).alias("r")))
    return sums.groupBy(*by).agg(F.coalesce(-F.max(counted)["r"], F.lit(MET)).cast("int").alias(reason))


def area_table(table: DataFrame, by: list[str], gap: Column, weight: str, standard: float) -> DataFrame:
    """people, missing, share and mean minutes short of those who miss the standard."""
    w = F.col(weight)
    missing = F.sum(F.when(gap > 0, w).otherwise(0.0))
    return table.groupBy(*by).agg(F.sum(w).alias("people"), missing.alias("missing"), (missing / F.nullif(F.sum(w), F.lit(0.0))).alias("share"), (F.sum(gap * w) * standard / F.nullif(missing, F.lit(0.0))).alias("minutes_short"))


def worst(table: DataFrame, by: list[str], order: list, top: int) -> DataFrame:
    """The first rows of each group; a report, so the limit is its meaning."""
    return table.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= top)


def parents(cells: DataFrame, child: str, parent: str, weight: str) -> DataFrame:
    """Parent of each child area by most of its people; ties to the first name."""
    sums = cells.groupBy(child, parent).agg(F.sum(weight).alias("w"))
    best = W.partitionBy(child).orderBy(F.desc("w"), parent)
    return sums.withColumn("_k", F.row_number().over(best)).filter("_k = 1").select(child, parent, F.col("w").alias("people"))


#: The numbers that edges of classes are rounded up to.
NICE = (1, 2, 5, 10, 15, 20, 25, 30, 40, 50, 75, 100, 150, 200, 250, 300, 400, 500)


def access_breaks(standard: Column) -> Column:
    """Five edges of classes of minutes around a standard; halves round up."""
    half_up = lambda c: F.floor(c + 0.5).cast("int")
    top = F.least(F.lit(60), half_up(standard * 2.25))
    return F.array(half_up(standard * 0.5), half_up(standard * 0.75), standard.cast("int"), F.least(half_up(standard * 1.5), half_up((standard + top) / 2)), top)


def class_of(value: Column, breaks: Column) -> Column:
    """How many of the edges lie below the value; null for none."""
    return F.when(value.isNotNull(), F.size(F.filter(breaks, lambda b: b < value)))


def quartile_breaks(table: DataFrame, by: list[str], value: str, key: str) -> DataFrame:
    """(by, breaks): three edges at the quarters of a group's positive values, rounded up to nice numbers and growing.

    The edge at q is the value at place floor(q n), counted from 0; beyond the nice numbers
    it is rounded up to a whole one. An edge that isn't above the one before is the next
    nice number, null if there is none. A group without a positive value has 1, 2, 5. Places
    are counted over ranges (``numbered``), so a group of any size is no task's alone.
    """
    rows = numbered(table.filter(F.col(value) > 0), by, [value, key], "_k", "_n")
    at = lambda q: F.max(F.when(F.col("_k") - 1 == F.least(F.floor(F.col("_n") * q), F.col("_n") - 1), F.col(value)))
    quarters = rows.groupBy(*by).agg(*[at(q).alias(f"_q{i}") for i, q in enumerate((0.25, 0.5, 0.75))])
    nice = F.array(*[F.lit(float(n)) for n in NICE])
    up = lambda v: F.coalesce(F.get(F.filter(nice, lambda n: n >= v), F.lit(0)), F.ceil(v).cast("double"))
    after = lambda v: F.get(F.filter(nice, lambda n: n > v), F.lit(0))
    step = lambda edges, v: F.concat(edges, F.array(F.when(up(v) <= F.element_at(edges, -1), after(F.element_at(edges, -1))).otherwise(up(v))))
    edges = step(step(F.array(up(F.col("_q0"))), F.col("_q1")), F.col("_q2"))
    none = F.array(F.lit(1.0), F.lit(2.0), F.lit(5.0))
    return table.select(*by).distinct().join(quarters, by, "left").select(*by, F.when(F.col("_q0").isNull(), none).otherwise(edges).alias("breaks"))


def chain(cells: DataFrame, levels: list[str], level: str, weight: str, near: float = 0.005) -> DataFrame:
    """(area, chain): of each area of ``level``, those around it, largest first and ending with it: structs of level, name and people.

    ``levels`` names columns of ``cells`` from the largest areas down. At each level above,
    the area that holds most of the area's people counts (ties to the lesser name; cells
    without people count a little). Where it has the same people as the one above it, within
    ``near``, it is left out, and so is the area itself if anything is above it; the whole
    place stands above all. Areas without people have no chain.
    """
    people = F.coalesce(F.greatest(F.col(weight), F.lit(0.0)), F.lit(0.0))
    total = cells.agg(F.sum(people).alias("_total"))
    out = cells.filter(F.col(level).isNotNull()).groupBy(F.col(level).alias("area")).agg(F.sum(people).alias("_own"))
    above = levels[: levels.index(level)]
    for k, name in enumerate(above):
        whole = cells.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("_name")).agg(F.sum(people).alias("_people"))
        parts = cells.filter(F.col(level).isNotNull() & F.col(name).isNotNull()).groupBy(F.col(level).alias("area"), F.col(name).alias("_name")).agg(F.sum(people + 1e-6).alias("_w"))
        most = parts.groupBy("area").agg(F.min_by("_name", F.struct((-F.col("_w")).alias("w"), F.col("_name"))).alias("_name"))
        most = most.join(whole, "_name").select("area", F.struct(F.lit(name).alias("level"), F.col("_name").cast("string").alias("name"), F.col("_people").alias("people")).alias(f"_a{k}"))
        out = out.join(most, "area", "left")
    out = out.join(F.broadcast(total))  # one row
    found, parent = F.array().cast("array<struct<level:string,name:string,people:double>>"), F.col("_total")
    for k in range(len(above)):
        a = F.col(f"_a{k}")
        takes = F.coalesce((a["people"] > 0) & (F.abs(a["people"] - parent) > near * parent), F.lit(False))
        out = out.withColumn(f"_f{k}", F.when(takes, F.concat(found, F.array(a))).otherwise(found)).withColumn(f"_p{k}", F.when(takes, a["people"]).otherwise(parent))
        found, parent = F.col(f"_f{k}"), F.col(f"_p{k}")
    own = F.struct(F.lit(level).alias("level"), F.col("area").cast("string").alias("name"), F.col("_own").alias("people"))
    whole_chain = F.when(F.abs(F.col("_own") - parent) > near * parent, F.concat(found, F.array(own))).otherwise(found)
    return out.filter("_own > 0").select("area", whole_chain.alias("chain")).filter(F.size("chain") > 0)


def sizes(cells: DataFrame, name: str, least: float, cell_area: float) -> DataFrame:
    """(name, size): how big areas are across: the geometric mean of the sides of their box, or, if less, the side of a square of their populated cells; no side below ``least``."""
    side = lambda c: F.greatest(F.max(c) - F.min(c), F.lit(least))
    size = F.least(F.sqrt(side("x") * side("y")), F.greatest(F.sqrt(F.count("*") * cell_area), F.lit(least)))
    return cells.groupBy(name).agg(size.alias("size"))
