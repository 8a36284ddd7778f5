"""Queries on fares and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachspark.operators import fares, measures
from reachspark.operators.common import dealt
from reachspark.plans.registry import query

CAP = 4
PRICES = (2.2, 3.9, 5.4, 6.8)


def _edges(t):
    """Zones next to each other share nations that follow each other."""
    n = t.raw("nation").select((F.col("n_nationkey") % 5).cast("int").alias("a"))
    return n.select("a", (F.col("a") + 1).alias("b")).filter("b < 5").distinct()


_HOPS = """edge as (select distinct a, a + 1 as b from (select cast(n_nationkey % 5 as int) as a from nation) where a + 1 < 5), both_ways as (select a, b from edge union select b, a from edge),
walk(a, b, zones) as (select distinct a, a, 1 from both_ways union select walk.a, both_ways.b, zones + 1 from walk join both_ways on walk.b = both_ways.a where zones < 4),
hops as (select a, b, min(zones) as zones from walk group by a, b)"""


@query("", "with recursive " + _HOPS + " select a, b, cast(zones as int) as zones from hops", (389, 415, 438))
def zone_distance(t):
    return fares.zone_distance(_edges(t), CAP)


def _rows(t) -> int:
    """At most so many pairs; a count of the files' footers."""
    return t.raw("lineitem").count()


def _zoned(t):
    cells = t.cells().select(F.col("cell").alias("origin"), F.col("zone").alias("oz"))
    ends = t.destinations().select(F.col("id").alias("destination"), F.col("zone").alias("dz"))
    return fares.pair_zones(t.pairs(), cells, ends, fares.zone_distance(_edges(t), CAP))


_ZONED = _HOPS + ", zoned as (select pairs.*, case when mode = 'walk' then 0 else zones end as zones from pairs join cells on origin = cell join destinations on destination = id left join hops on a = cells.zone and b = destinations.zone)"


@query("cells pairs", "with " + _ZONED + " select origin, destination, service, mode, minutes, cast(zones as int) as zones from zoned", (175,), recursive=True)
def pair_zone_counts(t):
    return _zoned(t).select("origin", "destination", "service", "mode", "minutes", "zones")


@query("cells pairs", "with " + _ZONED + """, best as (select origin, destination, weight, z, min(minutes) filter (where zones <= z) as m from zoned join destinations on destination = id, (select unnest(generate_series(0, 4)) as z) where minutes <= 30 group by all)
select origin, cast(z as int) as z, sum(case when m is not null then weight else 0 end) as reach, min(m) as nearest from best group by origin, z
""", (272, 273, 274, 419), recursive=True)
def fare_reachable(t):
    weights = t.destinations().select(F.col("id").alias("destination"), "weight")
    return fares.reachable_within(_zoned(t), weights, 30, CAP, _rows(t))


@query("cells pairs", "with " + _ZONED + """, best as (select origin, destination, weight, z, min(minutes) filter (where zones <= z) as m from zoned join destinations on destination = id, (select unnest(generate_series(0, 4)) as z) where minutes <= 30 group by all),
f as (select origin, z, sum(case when m is not null then weight else 0 end) as reach from best group by origin, z)
select cast(e.z as int) as z, quintile, round(sum(case when reach > 0 then population else 0 end) / nullif(sum(population), 0), 6) as any_share, round(sum(coalesce(reach, 0) * population) / nullif(sum(population), 0), 6) as mean_reach from cells cross join (select unnest(generate_series(0, 4)) as z) e left join f on origin = cell and f.z = e.z group by e.z, quintile
""", (271, 330), recursive=True)
def fare_summary(t):
    weights = t.destinations().select(F.col("id").alias("destination"), "weight")
    f = fares.reachable_within(_zoned(t), weights, 30, CAP, _rows(t)).withColumnRenamed("origin", "cell")
    f = measures.for_every_cell(t.cells(), list(range(CAP + 1)), f, "z", ["reach"]).withColumn("reach", F.coalesce("reach", F.lit(0.0)))
    p = F.nullif(F.sum("population"), F.lit(0.0))
    return f.groupBy("z", "quintile").agg(F.round(F.sum(F.when(F.col("reach") > 0, F.col("population")).otherwise(0.0)) / p, 6).alias("any_share"), F.round(F.sum(F.col("reach") * F.col("population")) / p, 6).alias("mean_reach"))


_PRICES = "[2.2, 3.9, 5.4, 6.8]::double[]"


@query("cells", f"""
select cell, round(income / 365 * 0.05, 6) as budget, cast(coalesce(list_max(list_filter([1, 2, 3, 4], lambda z: ({_PRICES})[z] * 2 <= income / 365 * 0.05 + 1e-9)), 0) as int) as zones from cells
""", (416, 422, 146))
def affordable_zones(t):
    budget = F.col("income") / 365 * 0.05
    prices = F.array(*[F.lit(p) for p in PRICES])
    return t.cells().select("cell", F.round(budget, 6).alias("budget"), fares.affordable_zones(prices, budget, CAP).alias("zones"))


@query("cells pairs", "with " + _ZONED + """, w as (select cell as origin, e.service, min(minutes) filter (where zones = 0) as m0, min(minutes) filter (where zones <= 1) as m1, min(minutes) filter (where zones <= 2) as m2, min(minutes) filter (where zones <= 3) as m3, min(minutes) filter (where zones <= 4) as m4
  from cells cross join (select distinct service from destinations where service is not null) e left join zoned on origin = cell and zoned.service = e.service group by cell, e.service)
select origin, service, case when coalesce(m0, m1, m2, m3, m4) is null then -1 when m0 <= 20 then 0 when m1 <= 20 then 1 when m2 <= 20 then 2 when m3 <= 20 then 3 when m4 <= 20 then 4 else -2 end as zones from w
""", (420, 421), recursive=True)
def cheapest_zones(t):
    """Every cell with every service: -1 where it is not reached at all."""
    at = lambda z: F.min(F.when(F.col("zones") <= z, F.col("minutes"))).alias(f"m{z}")
    steps = [f"m{z}" for z in range(CAP + 1)]
    w = dealt(_zoned(t).withColumnRenamed("origin", "cell"), ["cell"], _rows(t)).groupBy("cell", "service").agg(*[at(z) for z in range(CAP + 1)])
    w = measures.for_every_cell(t.cells().select("cell"), t.services(), w, "service", steps).withColumnRenamed("cell", "origin")
    return w.select("origin", "service", fares.cheapest_zones(w, ["m1", "m2", "m3", "m4"], 20, "m0").alias("zones"))


@query("cells", f"""
with b as (select quintile, population, ({_PRICES})[zone % 4 + 1] * 2 / (income / 365) as burden, least(({_PRICES})[zone % 4 + 1] * 2, 12.0) * 5 as five from cells where income > 0)
select quintile, case when burden < 0.025 then 0 when burden < 0.05 then 1 when burden < 0.1 then 2 else 3 end as class, round(sum(population), 2) as people, round(sum(burden * population) / nullif(sum(population), 0), 6) as mean_burden, round(avg(least(five, 50.0)), 6) as week from b group by all
""", (295, 327, 124, 424, 425, 441))
def fare_burden(t):
    single = fares.fare(F.array(*[F.lit(p) for p in PRICES]), F.col("zone") % 4 + 1, CAP)
    rows = t.cells().filter("income > 0").withColumn("burden", fares.burden(single * 2, F.col("income"))).withColumn("week", fares.week_cost(single, 5, 12.0, 50.0))
    rows = rows.withColumn("class", fares.burden_class(F.col("burden")))
    return rows.groupBy("quintile", "class").agg(F.round(F.sum("population"), 2).alias("people"), F.round(F.sum(F.col("burden") * F.col("population")) / F.nullif(F.sum("population"), F.lit(0.0)), 6).alias("mean_burden"), F.round(F.avg("week"), 6).alias("week"))


@query("cells pairs", "with " + _ZONED + """, best as (select origin, destination, weight, z, min(minutes) filter (where zones <= z) as m from zoned join destinations on destination = id, (select unnest(generate_series(0, 4)) as z) where minutes <= 45 group by all),
f as (select origin, z, sum(case when m is not null then weight else 0 end) as reach from best group by origin, z), top as (select origin, max(reach) as most from f group by origin)
select cell as origin, cast(case when most is null then -1 when most = 0 then -2 else min(z) filter (where reach >= most / 2) end as int) as zones from cells left join (f join top using (origin)) on origin = cell group by cell, most
""", (326,), recursive=True)
def commute_zones(t):
    """Fewest zones that reach half of what all zones do; -1 where nothing is reached."""
    weights = t.destinations().select(F.col("id").alias("destination"), "weight")
    f = fares.reachable_within(_zoned(t), weights, 45, CAP, _rows(t))
    steps = f.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("z", "reach"))).alias("s")).withColumn("most", F.array_max(F.transform("s", lambda x: x["reach"])))
    first = F.filter("s", lambda x: x["reach"] >= F.col("most") / 2)
    every = t.cells().select(F.col("cell").alias("origin")).join(steps, "origin", "left")
    return every.select("origin", F.when(F.col("most").isNull(), -1).when(F.col("most") == 0, -2).otherwise(F.element_at(first, 1)["z"]).cast("int").alias("zones"))
