"""Queries on residents and ages."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachspark.operators import people
from reachspark.operators.common import dealt
from reachspark.plans.registry import query

_BLOCK = """block as (select c_custkey as block, n_name as area, case when c_acctbal >= 0 then c_acctbal end as residents, case when c_custkey % 4 <> 0 and c_acctbal >= 0 then c_acctbal * 0.2 end as young, case when c_custkey % 5 <> 0 and c_acctbal >= 0 then c_acctbal * 0.1 end as old from customer join nation on c_nationkey = n_nationkey)"""


def _blocks(t):
    c = t.raw("customer").join(F.broadcast(t.raw("nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    k, n = F.col("c_custkey"), people.count(F.col("c_acctbal"))
    return c.select(k.alias("block"), F.col("n_name").alias("area"), n.alias("residents"), F.when(k % 4 != 0, n * 0.2).alias("young"), F.when(k % 5 != 0, n * 0.1).alias("old"))


@query("", "with " + _BLOCK + """, r as (select *, sum(young) over (partition by area) / nullif(sum(case when young is not null then residents end) over (partition by area), 0) as y, sum(old) over (partition by area) / nullif(sum(case when old is not null then residents end) over (partition by area), 0) as o from block)
select block, area, residents, round(coalesce(young, residents * y), 6) as young, round(coalesce(old, residents * o), 6) as old from r
""", (110, 285, 181))
def fill_bands(t):
    f = people.fill_bands(_blocks(t), ["young", "old"], "area", "residents")
    return f.select("block", "area", "residents", F.round("young", 6).alias("young"), F.round("old", 6).alias("old"))


@query("", "with " + _BLOCK + " select block, round(coalesce(young, 0) * 0.6 + coalesce(old, 0) * 0.2, 6) as school, round(coalesce(young, 0) * 0.4, 6) as infant, round(case when residents > 0 then least(greatest(young / residents, 0), 1) end, 6) as young_share from block", (111, 286, 287, 159, 292))
def age_groups(t):
    b = _blocks(t).withColumn("y", F.coalesce("young", F.lit(0.0))).withColumn("o", F.coalesce("old", F.lit(0.0)))
    groups = people.regroup({"school": {"y": 0.6, "o": 0.2}, "infant": {"y": 0.4}})
    out = b.select("block", *groups, people.share(F.col("young"), F.col("residents")).alias("young_share"))
    return out.select("block", *[F.round(c, 6).alias(c) for c in ("school", "infant", "young_share")])


@query("", """
with piece as (select o_custkey as block, o_orderkey % 997 as cell, o_totalprice as area from orders), part as (select *, area / nullif(sum(area) over (partition by block), 0) as s from piece)
select cell, round(sum(greatest(c_acctbal, 0) * s), 4) as people, round(sum(s), 6) as blocks from part join customer on block = c_custkey group by cell
""", (208, 232, 233, 288))
def spread_blocks(t):
    pieces = t.raw("orders").select(F.col("o_custkey").alias("block"), (F.col("o_orderkey") % 997).alias("cell"), F.col("o_totalprice").alias("area"))
    values = t.raw("customer").select(F.col("c_custkey").alias("block"), F.greatest("c_acctbal", F.lit(0.0)).alias("people"), F.lit(1.0).alias("blocks"))
    s = people.spread(pieces, values, "block", "cell", ["people", "blocks"])
    return s.select("cell", F.round("people", 4).alias("people"), F.round("blocks", 6).alias("blocks"))


@query("cells", """
with p as (select sum(population * older) / sum(population) as place_share from cells)
select cell, round(case when household > 0 then older * population else place_share * population end, 6) as children from cells, p
""", (289,))
def to_grid(t):
    c = t.cells().withColumn("res", F.when(F.col("household") > 0, F.lit(1.0)).otherwise(0.0)).withColumn("kids", F.col("older"))
    place = c.agg((F.sum(F.col("population") * F.col("older")) / F.sum("population")).alias("place_share"))
    return c.join(F.broadcast(place)).select("cell", F.round(people.to_grid(c, "kids", "res", "population"), 6).alias("children"))  # one row


@query("cells", "select cell, sa2, not regexp_matches(sa2, '_1[0-9]$') and sum(population) over (partition by sa2) >= 1000 as urban from cells", (112, 128, 496))
def urban_flag(t):
    return people.urban(t.cells().select("cell", "sa2", "population"), "sa2", "population", "_1[0-9]$").select("cell", "sa2", "urban")


@query("cells", "select cell, round(case when household >= 1 and income > 0 then income * 1.05 / sqrt(household) end, 6) as equivalised, round(income / 365, 6) as daily from cells", (294, 160, 423))
def equivalised_income(t):
    return t.cells().select("cell", F.round(people.equivalised(F.col("income"), F.col("household"), 1.05), 6).alias("equivalised"), F.round(F.col("income") / 365, 6).alias("daily"))


@query("", """
with g as (select o_orderkey, l_linenumber, sum(l_quantity * 1.07) as v from orders join lineitem on o_orderkey = l_orderkey group by all),
f as (select *, floor(round(v, 9)) as low, round(v - floor(round(v, 9)), 9) as rest, sum(v) over (partition by o_orderkey) as total from g)
select o_orderkey, l_linenumber, cast(low + case when row_number() over (partition by o_orderkey order by rest desc, l_linenumber) <= cast(round(round(total, 6)) as bigint) - sum(low) over (partition by o_orderkey) then 1 else 0 end as bigint) as whole from f
""", (370, 408))
def largest_remainder_all(t):
    """Of every order."""
    return _whole_quantities(t.raw("lineitem"), t.raw("orders"))


@query("", """
with g as (select l_partkey, l_suppkey, sum(l_extendedprice / 100) as v from lineitem group by all),
f as (select *, floor(round(v, 9)) as low, round(v - floor(round(v, 9)), 9) as rest, sum(v) over (partition by l_partkey) as total from g)
select l_partkey, l_suppkey, cast(low + case when row_number() over (partition by l_partkey order by rest desc, l_suppkey) <= cast(round(round(total, 6)) as bigint) - sum(low) over (partition by l_partkey) then 1 else 0 end as bigint) as whole from f
""", (370,))
def largest_remainder(t):
    """Whole hundreds of a part's price by supplier."""
    from pyspark.sql import Window as W

    rows = t.raw("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum(F.col("l_extendedprice") / 100).alias("v")).withColumn("total", F.round(F.sum("v").over(W.partitionBy("l_partkey")), 6))
    return people.whole_parts(rows, ["l_partkey"], "l_suppkey", "v", "total").select("l_partkey", "l_suppkey", "whole")


def _whole_quantities(lines, orders):
    from pyspark.sql import Window as W

    lines = dealt(lines.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], lines.count())  # a count of the files' footers
    rows = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    rows = rows.groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").agg(F.sum(F.col("l_quantity") * 1.07).alias("v")).withColumn("total", F.round(F.sum("v").over(W.partitionBy("o_orderkey")), 6))
    return people.whole_parts(rows, ["o_orderkey"], "l_linenumber", "v", "total").select("o_orderkey", "l_linenumber", "whole")


@query("cells", """
select council, round(sum(population * 0.49 * older) / nullif(sum(population * older), 0), 6) as girls, round(avg(income), 6) as mean_income, count(distinct sa2) as areas from cells group by council
""", (291,))
def sex_shares(t):
    w = F.col("population") * F.col("older")
    return t.cells().groupBy("council").agg(F.round(F.sum(F.col("population") * 0.49 * F.col("older")) / F.nullif(F.sum(w), F.lit(0.0)), 6).alias("girls"), F.round(F.avg("income"), 6).alias("mean_income"), F.count_distinct("sa2").alias("areas"))


@query("cells", "select cell, service_group, round(w, 6) as w from (select cell, unnest(['older', 'no_car', 'all']) as service_group, unnest([population * older, population * no_car, population]) as w from cells) where w > 0", (264, 470, 478, 497, 498))
def group_weights(t):
    g = F.array(*[F.struct(F.lit(n).alias("service_group"), w.alias("w")) for n, w in (("older", F.col("population") * F.col("older")), ("no_car", F.col("population") * F.col("no_car")), ("all", F.col("population")))])
    return t.cells().select("cell", F.explode(g).alias("g")).select("cell", "g.service_group", F.round("g.w", 6).alias("w")).filter("w > 0")
