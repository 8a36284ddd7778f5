"""Queries of weighted statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachspark.operators import measures, stats
from reachspark.plans.registry import query

_R6 = lambda *names: [F.round(n, 6).alias(n) for n in names]


def _times(t):
    """(the cell's columns, service, minutes): every cell with every service that exists; minutes are null where it reaches none."""
    best = t.pairs().groupBy(F.col("origin").alias("cell"), "service").agg(F.min("minutes").alias("minutes"))
    return measures.for_every_cell(t.cells(), t.services(), best, "service", ["minutes"])


_TIMES = """times as (select cells.*, e.service, minutes from cells cross join (select distinct service from destinations) e
  left join (select origin, service, min(minutes) as minutes from pairs group by origin, service) b on origin = cell and b.service = e.service)"""


@query("cells pairs", "with " + _TIMES + """
select service, quintile, round(sum(case when minutes <= 10 then population else 0 end) / nullif(sum(population), 0), 6) as share, round(sum(population), 2) as population from times group by service, quintile
""", (265, 302, 303, 305, 340, 341))
def weighted_share_by_quintile(t):
    return _times(t).groupBy("service", "quintile").agg(F.round(stats.share(F.coalesce(F.col("minutes") <= 10, F.lit(False)), F.col("population")), 6).alias("share"), F.round(F.sum("population"), 2).alias("population"))


@query("cells pairs", "with " + _TIMES + """
select service, council, case when sum(population) >= 100 then round(sum(case when minutes <= 10 then population else 0 end) / nullif(sum(population), 0), 6) end as share from times group by service, council
""", (305, 343))
def share_where_enough(t):
    s = F.round(stats.share(F.col("minutes") <= 10, F.col("population")), 6)
    return _times(t).groupBy("service", "council").agg(stats.enough(F.col("population"), s).alias("share"))


_CUM = "with " + _TIMES + ", c as (select *, round(sum(population) over (partition by service order by minutes, cell rows unbounded preceding) / sum(population) over (partition by service), 9) as cum from times where population > 0 and minutes is not null)"


@query("cells pairs", _CUM + " select service, min(minutes) as median from c where cum >= 0.5 group by service", (299, 308, 354))
def weighted_median(t):
    return stats.quantile(_times(t), "minutes", "population", "cell", ["service"], 0.5, "median")


@query("cells", """
with c as (select *, round(sum(population) over (partition by council order by income, cell rows unbounded preceding) / sum(population) over (partition by council), 9) as cum from cells where population > 0)
select council, min(income) filter (where cum >= 0.1) / 365 as low, min(income) filter (where cum >= 0.9) / 365 as high from c group by council
""", (365, 423))
def income_range(t):
    c = stats.cumulative(t.cells(), "income", "population", "cell", ["council"])
    at = lambda q: F.min(F.when(F.col("cum") >= q, F.col("income"))) / 365
    return c.groupBy("council").agg(at(0.1).alias("low"), at(0.9).alias("high"))


_REACHED = "reached as (select cell, population, nzdep, quintile, council, older, no_car, sa2, coalesce(sum(weight) filter (where minutes <= 20), 0) as jobs from cells left join pairs on origin = cell left join destinations on destination = id group by all)"


def _jobs(t):
    weights = t.destinations().select(F.col("id").alias("destination"), "weight")
    got = measures.weight_within(t.pairs(), weights, ["origin"], (20,))
    return t.cells().join(got, F.col("origin") == F.col("cell"), "left").withColumn("jobs", F.coalesce("jobs_20", F.lit(0.0)))


@query("cells pairs destinations", "with " + _REACHED + """, c as (select *, round(sum(population) over (partition by council order by jobs, cell rows unbounded preceding) / sum(population) over (partition by council), 9) as cum from reached where population > 0),
p as (select council, sum(jobs * population) filter (where cum <= 0.4) / sum(population) filter (where cum <= 0.4) as low, sum(jobs * population) filter (where cum > 0.9) / sum(population) filter (where cum > 0.9) as high from c group by council)
select council, round(low, 6) as low, round(high, 6) as high, round(high / nullif(low, 0), 6) as palma, low = 0 as least_have_nothing from p
""", (267, 355, 356, 357))
def palma(t):
    p = stats.palma(_jobs(t), "jobs", "population", "cell", ["council"])
    return p.select("council", *_R6("low", "high", "palma"), "least_have_nothing")


@query("cells pairs destinations", "with " + _REACHED + """
select cell, council, jobs, cast(least(9, greatest(0, floor(10 * ((sum(population) over (partition by council order by jobs) - sum(population) over (partition by council, jobs) / 2) / sum(population) over (partition by council)) - 1e-9))) as int) as band
from reached where population > 0
""", (353,))
def decile_bands_ties(t):
    return stats.tied_bands(_jobs(t).filter("population > 0"), "jobs", "population", ["council"]).select("cell", "council", "jobs", "band")


@query("cells pairs destinations", "with " + _REACHED + """
select cell, jobs, round((sum(population) over (partition by council order by jobs range unbounded preceding) - sum(population) over (partition by council, jobs)) / sum(population) over (partition by council), 6) as below from reached where population > 0
""", (364,))
def rank_among(t):
    return stats.below(_jobs(t).filter("population > 0"), "jobs", "population", ["council"]).select("cell", "jobs", F.round("below", 6).alias("below"))


@query("cells pairs destinations", "with " + _REACHED + """, r as (select *, (sum(population) over (partition by council order by nzdep desc) - sum(population) over (partition by council, nzdep) / 2) / sum(population) over (partition by council) as r from reached where population > 0),
s as (select council, sum(population) as w, sum(population * jobs) as wv, sum(population * r) as wr, sum(population * jobs * r) as wvr from r group by council)
select council, case when wv <> 0 then round(2 * (wvr / w - wv / w * wr / w) / (wv / w), 6) end as concentration from s
""", (358,))
def concentration_index(t):
    return stats.concentration(_jobs(t), "jobs", "population", "nzdep", ["council"]).select("council", *_R6("concentration"))


_GAP = ", g as (select *, greatest(0.0, (coalesce(cast(minutes as double), 60.0) - 10) / 10) as gap from times)"
_FGT = "round(sum(case when gap > 0 then {w} else 0 end) / nullif(sum({w}), 0), 6) as rate, round(sum({w} * gap) / nullif(sum({w}), 0), 6) as depth, round(sum({w} * gap * gap) / nullif(sum({w}), 0), 6) as severity, round(sum({w} * gap) * 10 / nullif(sum(case when gap > 0 then {w} else 0 end), 0), 6) as minutes_short"


@query("cells pairs", "with " + _TIMES + _GAP + " select service, " + _FGT.format(w="population") + " from g group by service", (309, 310, 332))
def fgt(t):
    gap = stats.shortfall(F.col("minutes"), 10.0)
    return _times(t).groupBy("service").agg(*stats.fgt(gap, F.col("population"), 10.0)).select("service", *_R6("rate", "depth", "severity", "minutes_short"))


@query("cells pairs", "with " + _TIMES + _GAP + """, u as (select 'all' as grp, population as w, gap from g union all select 'older', population * older, gap from g union all select 'no_car', population * no_car, gap from g)
select grp, """ + _FGT.format(w="w") + " from u group by grp", (264, 312))
def fgt_by_group(t):
    rows = _times(t).withColumn("gap", stats.shortfall(F.col("minutes"), 10.0))
    groups = F.array(F.struct(F.lit("all").alias("grp"), F.col("population").alias("w")), *[F.struct(F.lit(g).alias("grp"), (F.col("population") * F.col(g)).alias("w")) for g in ("older", "no_car")])
    long = rows.select("gap", F.explode(groups).alias("g")).select("gap", "g.*")
    return long.groupBy("grp").agg(*stats.fgt(F.col("gap"), F.col("w"), 10.0)).select("grp", *_R6("rate", "depth", "severity", "minutes_short"))


@query("cells pairs", """
with w as (select cells.*, min(minutes) filter (where mode = 'pt') as priced, min(minutes) as free from cells left join pairs on origin = cell group by all)
select council, round(sum(case when free <= 8 and not coalesce(priced <= 8, false) then population else 0 end), 2) as priced_out, round(sum(case when not coalesce(free <= 8, false) then population else 0 end), 2) as too_far from w group by council
""", (311,))
def priced_out(t):
    p = t.pairs().groupBy(F.col("origin").alias("cell")).agg(F.min(F.when(F.col("mode") == "pt", F.col("minutes"))).alias("priced"), F.min("minutes").alias("free"))
    w = t.cells().join(p, "cell", "left")
    met = lambda c: F.coalesce(F.col(c) <= 8, F.lit(False))
    total = lambda keep: F.round(F.sum(F.when(keep, F.col("population")).otherwise(0.0)), 2)
    return w.groupBy("council").agg(total(met("free") & ~met("priced")).alias("priced_out"), total(~met("free")).alias("too_far"))


@query("cells pairs destinations", "with " + _REACHED + """, a as (select sa2, round(sum(jobs * population) / nullif(sum(population), 0), 9) as access, round(sum(no_car * population) / nullif(sum(population), 0), 9) as no_car from reached group by sa2),
r as (select rank() over (order by access) + (count(*) over (partition by access) - 1) / 2 as ra, rank() over (order by no_car) + (count(*) over (partition by no_car) - 1) / 2 as rb from a where access is not null and no_car is not null)
select round(corr(ra, rb), 6) as rho, count(*) as areas from r
""", (269,))
def commute_spearman(t):
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("population")) / F.nullif(F.sum("population"), F.lit(0.0)), 9).alias("access" if c == "jobs" else c)
    a = _jobs(t).groupBy("sa2").agg(mean("jobs"), mean("no_car"))
    return stats.spearman(a, "access", "no_car").select(F.round("rho", 6).alias("rho"), "areas")


@query("cells pairs", "with " + _TIMES + _GAP + """, p as (select sum(population * older) / sum(population) as place from cells), s as (
  select service, sa2, sum(population * older) / nullif(sum(population), 0) as share, round(sum(case when gap > 0 then population * older else 0 end), 4) as missing from g group by service, sa2)
select service, sa2, round(share, 6) as share, missing, case when share is null then null when share < 0.5 * place - 1e-9 then 0 when share < place - 1e-9 then 1 when share < 1.5 * place - 1e-9 then 2 when share < 2 * place - 1e-9 then 3 else 4 end as class from s, p
""", (313, 314, 315, 333))
def where_they_live(t):
    rows = _times(t).withColumn("gap", stats.shortfall(F.col("minutes"), 10.0)).withColumn("w", F.col("population") * F.col("older"))
    place = t.cells().agg((F.sum(F.col("population") * F.col("older")) / F.sum("population")).alias("place"))
    s = rows.groupBy("service", "sa2").agg((F.sum("w") / F.nullif(F.sum("population"), F.lit(0.0))).alias("share"), F.round(F.sum(F.when(F.col("gap") > 0, F.col("w")).otherwise(0.0)), 4).alias("missing"))
    c = F.when(F.col("share").isNull(), None)
    for k, part in enumerate((0.5, 1.0, 1.5, 2.0)):
        c = c.when(F.col("share") < part * F.col("place") - 1e-9, k)
    return s.join(F.broadcast(place)).select("service", "sa2", F.round("share", 6).alias("share"), "missing", c.otherwise(4).alias("class"))  # one row


@query("cells pairs", "with " + _TIMES + """, s as (select service, standard, sum(case when minutes <= standard then population else 0 end) / nullif(sum(population), 0) as share from times, (select unnest(generate_series(5, 60, 5)) as standard) group by service, standard)
select service, cast(standard as int) as standard, round(share, 6) as share from s
""", (328,))
def share_curve(t):
    rows = _times(t).select("service", "population", "minutes", F.explode(F.sequence(F.lit(5), F.lit(60), F.lit(5))).alias("standard"))
    return rows.groupBy("service", "standard").agg(F.round(stats.share(F.col("minutes") <= F.col("standard"), F.col("population")), 6).alias("share"))


@query("cells pairs_w", """
with w as (select origin, service, max(n) as worst, count(*) as wins from (select origin, service, win, min(minutes) as n from pairs_w group by all) group by origin, service)
select e.service, round(sum(case when wins = 2 and worst <= 20 then population else 0 end) / nullif(sum(population), 0), 6) as share from cells cross join (select distinct service from destinations) e left join w on origin = cell and w.service = e.service group by e.service
""", (328,))
def share_at_every_time(t):
    p = t.pairs(windows=True).groupBy("origin", "service", "win").agg(F.min("minutes").alias("n")).groupBy(F.col("origin").alias("cell"), "service").agg(F.max("n").alias("worst"), F.count("*").alias("wins"))
    rows = measures.for_every_cell(t.cells(), t.services(), p, "service", ["worst", "wins"])
    return rows.groupBy("service").agg(F.round(stats.share((F.col("wins") == 2) & (F.col("worst") <= 20), F.col("population")), 6).alias("share"))
