"""Queries on travel times: merging, nearest, counts, standards, jobs, gravity."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachspark.operators import gravity, measures, merge
from reachspark.plans.registry import query

PAIR = ["origin", "destination", "service"]


@query("pairs", """
with pt as (select * from pairs where mode = 'pt' and minutes <= 40), w as (
  select origin, destination, service, cast(floor(minutes * 1.25 + 1e-9) as int) as walk from pairs where mode = 'walk'), foot as (select * from w where walk <= 40)
select coalesce(pt.origin, foot.origin) as origin, coalesce(pt.destination, foot.destination) as destination, coalesce(pt.service, foot.service) as service,
  least(pt.minutes, walk) as minutes, pt.minutes as r5, walk, walk is not null and not coalesce(pt.minutes < walk, false) as walk_quicker
from pt full join foot on pt.origin = foot.origin and pt.destination = foot.destination and pt.service = foot.service
""", (148, 150, 411, 413, 414))
def pt_or_walk_merge(t):
    p = t.pairs()
    return merge.merge_walk(p.filter("mode = 'pt'"), p.filter("mode = 'walk'"), PAIR, 40, 1.25)


@query("pairs", """
with pt as (select *, minutes - destination % 3 as lo, case when minutes + destination % 9 <= 45 then cast(minutes + destination % 9 as bigint) end as hi from pairs where mode = 'pt' and minutes <= 45),
foot as (select origin, destination, service, minutes as walk from pairs where mode = 'walk' and minutes <= 45)
select origin, destination, service, least(pt.minutes, walk) as minutes, pt.minutes as r5, walk, walk is not null and not coalesce(pt.minutes < walk, false) as walk_quicker, least(lo, walk) as lo, least(hi, walk) as hi
from pt full join foot using (origin, destination, service)
""", (148,))
def pt_or_walk_spread(t):
    p = t.pairs()
    pt = p.filter("mode = 'pt'").withColumn("lo", F.col("minutes") - F.col("destination") % 3)
    hi = F.col("minutes") + F.col("destination") % 9
    return merge.merge_walk(pt.withColumn("hi", F.when(hi <= 45, hi)), p.filter("mode = 'walk'"), PAIR, 45, spread=True)


@query("pairs", """
with best as (select origin, service, mode, min(row(minutes, destination)) as b from pairs where minutes <= 60 group by all),
wide as (select origin, service, max(case when mode = 'pt' then b[1] end) as r5, max(case when mode = 'pt' then b[2] end) as r5_id, max(case when mode = 'walk' then b[1] end) as walk, max(case when mode = 'walk' then b[2] end) as walk_id from best group by all)
select origin, service, case when walk is not null and (r5 is null or walk < r5) then walk else r5 end as minutes, case when walk is not null and (r5 is null or walk < r5) then walk_id else r5_id end as nearest_id from wide
where r5 is not null or walk is not null
""", (149,))
def merge_nearest_named(t):
    best = measures.nearest(t.pairs(), ["origin", "service", "mode"])
    of = lambda mode, c: F.max(F.when(F.col("mode") == mode, F.col(c)))
    wide = best.groupBy("origin", "service").agg(of("pt", "minutes").alias("r5"), of("pt", "nearest_id").alias("r5_id"), of("walk", "minutes").alias("walk"), of("walk", "nearest_id").alias("walk_id"))
    return merge.merge_nearest(wide).filter("r5 is not null or walk is not null").select("origin", "service", "minutes", "nearest_id")


@query("pairs", """
select origin, destination, min(minutes) as minutes from pairs where mode in ('pt', 'bike') group by origin, destination
""", (151,))
def catchment_pairs(t):
    p = t.pairs()
    return merge.catchment(p.filter("mode = 'pt'"), p.filter("mode = 'bike'"), ["origin", "destination"])


@query("pairs", """
select origin, destination, b[1] as minutes, b[3] as mode from (
  select origin, destination, min(row(minutes, case mode when 'walk' then 1 when 'bike' then 2 else 3 end, mode)) as b from pairs group by all)
""", (401, 429))
def fastest_mode_of_pairs(t):
    return merge.fastest_mode(t.pairs(), ["origin", "destination"], ["walk", "bike", "pt"])


@query("reach", """
select cell, area, school, minutes, metres, mode from (
  select reach.*, s_nationkey as area, row_number() over (partition by cell, s_nationkey order by minutes, metres, school, mode) as k from reach join supplier on school = s_suppkey) where k = 1
""", (156, 157, 254))
def collapse_entrances(t):
    area = t.schools().select("school", "area")
    return merge.collapse(t.reach().join(area, "school"), ["cell", "area"], "minutes", "metres", "school", "mode").select("cell", "area", "school", "minutes", "metres", "mode")


@query("pairs", """
select origin, service, mode, b[1] as minutes, b[2] as nearest_id from (select origin, service, mode, min(row(minutes, destination)) as b from pairs where minutes <= 45 group by all)
""", (252,))
def service_nearest(t):
    return measures.nearest(t.pairs(), ["origin", "service", "mode"], 45)


@query("pairs", """
select origin, service, mode, count(*) filter (where minutes <= 10) as n10, count(*) filter (where minutes <= 15) as n15, count(*) filter (where minutes <= 20) as n20, count(*) filter (where minutes <= 30) as n30
from pairs group by origin, service, mode
""", (82, 154, 255, 256, 277))
def service_counts(t):
    return measures.counts_within(t.pairs(), ["origin", "service", "mode"])


_WIDE = """with wide as (select cell as origin, e.service, min(minutes) filter (where mode = 'walk') as walk, min(minutes) filter (where mode = 'bike') as bike, min(minutes) filter (where mode = 'pt') as pt
  from cells cross join (select distinct service from destinations where service is not null) e left join pairs on cell = origin and pairs.service = e.service group by cell, e.service)"""


@query("cells pairs", _WIDE + """
select origin, service, walk, bike, pt, least(walk, bike, pt) as best, case least(walk, bike, pt) when walk then 'walk' when bike then 'bike' when pt then 'pt' end as via,
  coalesce(least(walk, bike, pt) <= 20, false) as meets,
  cast(coalesce(walk <= 20, false) as int) + cast(coalesce(bike <= 20, false) as int) + cast(coalesce(pt <= 20, false) and coalesce(pt < walk, true) as int) as options from wide
""", (132, 152, 428, 430, 301))
def standards_best(t):
    """Every cell with every service; one that is not reached has no best time and does not meet the standard."""
    modes = ["walk", "bike", "pt"]
    times = measures.by_mode(t.pairs(), [F.col("origin").alias("cell"), "service"], tuple(modes))
    every = measures.for_every_cell(t.cells().select("cell"), t.services(), times, "service", modes)
    return measures.standards(every.withColumnRenamed("cell", "origin"), 20)


@query("cells pairs destinations", """
with got as (select origin, mode, minutes, weight from pairs join destinations on destination = id)
select cell as origin, e.mode, coalesce(sum(case when minutes <= 15 then weight else 0 end), 0) as jobs_15, coalesce(sum(case when minutes <= 30 then weight else 0 end), 0) as jobs_30, coalesce(sum(case when minutes <= 45 then weight else 0 end), 0) as jobs_45
from cells cross join (values ('walk'), ('bike'), ('pt')) e(mode) left join got on origin = cell and got.mode = e.mode group by cell, e.mode
""", (253, 257, 174))
def jobs_within(t):
    """Every cell by every mode; one that reaches nothing has 0."""
    weights = t.destinations().select(F.col("id").alias("destination"), "weight")
    got = measures.weight_within(t.pairs(), weights, [F.col("origin").alias("cell"), "mode"], (15, 30, 45))
    jobs = [f"jobs_{m}" for m in (15, 30, 45)]
    every = measures.for_every_cell(t.cells().select("cell"), ["walk", "bike", "pt"], got, "mode", jobs)
    return every.select(F.col("cell").alias("origin"), "mode", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in jobs])


@query("cells pairs destinations", """
with total as (select sum(weight) as total from destinations), got as (
  select origin, mode, sum(case when minutes <= 30 then weight else 0 end) as jobs from pairs join destinations on destination = id group by origin, mode)
select e.mode, quintile, round(sum(coalesce(jobs, 0) / total * population) / nullif(sum(population), 0), 6) as share from cells cross join (values ('walk'), ('bike'), ('pt')) e(mode) left join got on origin = cell and got.mode = e.mode, total group by e.mode, quintile
""", (257,))
def jobs_share_by_quintile(t):
    weights = t.destinations().select(F.col("id").alias("destination"), "weight")
    total = weights.agg(F.sum("weight").alias("total"))
    got = measures.weight_within(t.pairs(), weights, [F.col("origin").alias("cell"), "mode"], (30,))
    every = measures.for_every_cell(t.cells(), ["walk", "bike", "pt"], got, "mode", ["jobs_30"]).join(F.broadcast(total))  # one row
    of_all = F.coalesce("jobs_30", F.lit(0.0)) / F.col("total")
    return every.groupBy("mode", "quintile").agg(F.round(F.sum(of_all * F.col("population")) / F.nullif(F.sum("population"), F.lit(0.0)), 6).alias("share"))


@query("cells pairs destinations", """
with near as (select distinct origin, destination from pairs where mode = 'pt' and minutes <= 25), wanted as (
  select destination, sum(population) as demand from near join cells on origin = cell group by destination), supply as (
  select destination, case when demand > 0 then weight / demand else 0 end as ratio from wanted join destinations on destination = id), raw as (
  select cell, population, coalesce(sum(ratio), 0) as raw from cells left join near on origin = cell left join supply using (destination) group by cell, population)
select cell as origin, round(raw / (select sum(raw * population) / sum(population) from raw), 6) as access from raw
""", (258,))
def jobs_competition(t):
    weights = t.destinations().select(F.col("id").alias("destination"), "weight")
    demand = t.cells().select(F.col("cell").alias("origin"), F.col("population").alias("demand"))
    return measures.competition_adjusted(t.pairs().filter("mode = 'pt'"), weights, demand, 25).select("origin", F.round("access", 6).alias("access"))


def _gravity(t, kind, a, b=0.0, mode="pt"):
    weights = t.destinations().select(F.col("id").alias("destination"), "weight")
    return gravity.score(t.pairs().filter(F.col("mode") == mode), weights, gravity.impedance(F.col("minutes"), kind, a, b), ["origin", "service"])




@query("pairs destinations", "with s as (select origin, pairs.service, sum(weight * exp(-0.05 * minutes)) as score from pairs join destinations on destination = id where mode = 'pt' group by all) select origin, service, round(score, 6) as score from s", (259, 409, 412))
def gravity_score_exp(t):
    return _gravity(t, "exponential", 0.05).select("origin", "service", F.round("score", 6).alias("score"))


@query("pairs destinations", "with s as (select origin, pairs.service, sum(weight * exp(-0.002 * minutes * minutes)) as score from pairs join destinations on destination = id where mode = 'pt' group by all) select origin, service, round(score, 6) as score from s", (409,))
def gravity_score_gaussian(t):
    return _gravity(t, "gaussian", 0.002).select("origin", "service", F.round("score", 6).alias("score"))


@query("pairs destinations", """
with m as (select quantile_cont(minutes, 0.5) as m from pairs where mode = 'pt'), s as (
  select origin, pairs.service, sum(weight / (1 + pow(minutes / m, 2.5))) as score from pairs join destinations on destination = id, m where mode = 'pt' group by all)
select origin, service, round(score, 6) as score from s
""", (262, 409))
def gravity_score_loglogistic(t):
    pt = t.pairs().filter("mode = 'pt'")
    middle = pt.agg(F.percentile("minutes", 0.5)).first()[0]
    if middle is None:
        middle = 1.0
    return _gravity(t, "loglogistic", float(middle), 2.5).select("origin", "service", F.round("score", 6).alias("score"))


def _propensity_sql() -> str:
    import math

    c0, c1, c2, c3 = (-3.9, -0.59, 1.8, 0.008)
    at = lambda d: 1 / (1 + math.exp(-(c0 + c1 * d + c2 * math.sqrt(d) + c3 * d * d)))
    peak = max((30.0 * i / 3000 for i in range(3001)), key=at)
    return f"""with d as (select origin, weight, greatest(minutes * 15 / 60, cast({peak!r} as double)) as d from pairs join destinations on destination = id where mode = 'bike')
    select origin, round(sum(weight * (1 / (1 + exp(-({c0} + {c1} * d + {c2} * sqrt(d) + {c3} * d * d))) / {at(peak)!r})), 6) as score from d group by origin"""


@query("pairs destinations", _propensity_sql(), (410, 411))
def gravity_score_propensity(t):
    weights = t.destinations().select(F.col("id").alias("destination"), "weight")
    decay = gravity.propensity(F.col("minutes"), 15.0, (-3.9, -0.59, 1.8, 0.008))
    return gravity.score(t.pairs().filter("mode = 'bike'"), weights, decay, ["origin"]).select("origin", F.round("score", 6).alias("score"))


_SQL_SCORE = "s as (select origin, pairs.service, sum(weight * exp(-0.05 * minutes)) as score from pairs join destinations on destination = id where mode = 'pt' group by all), v as (select cell, e.service, round(coalesce(score, 0), 6) as score, population from cells cross join (select distinct service from destinations) e left join s on origin = cell and s.service = e.service)"


def _scored(t):
    """Every cell with every service; one that reaches none scores 0."""
    s = _gravity(t, "exponential", 0.05).withColumnRenamed("origin", "cell")
    return measures.for_every_cell(t.cells(), t.services(), s, "service", ["score"]).select("cell", "service", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"), "population")


@query("cells pairs destinations", "with " + _SQL_SCORE + """
select cell, service, score, cast(least(10, greatest(1, ceil(round(sum(population) over (partition by service order by score, cell rows unbounded preceding) / sum(population) over (partition by service) * 10, 9)))) as int) as decile
from v where population > 0
""", (352, 263))
def gravity_decile(t):
    return gravity.deciles(_scored(t).filter("population > 0"), "score", "population", "cell", ["service"]).select("cell", "service", "score", "decile")


@query("cells pairs destinations", "with " + _SQL_SCORE + """, m as (select service, sum(score * population) / nullif(sum(population), 0) as mean from v group by service)
select cell, service, round(case when mean > 0 then 100 * score / mean end, 6) as idx from v join m using (service)
""", (260, 261))
def gravity_index(t):
    return gravity.index_to_mean(_scored(t), "score", "population", ["service"]).select("cell", "service", F.round("idx", 6).alias("idx"))


@query("cells pairs_w destinations", """
with s as (select origin, win, sum(weight * exp(-0.05 * minutes)) as score from pairs_w join destinations on destination = id where mode = 'pt' group by all),
v as (select cell, e.win, round(coalesce(score, 0), 6) as score, population from cells cross join (values ('usual'), ('saturday')) e(win) left join s on origin = cell and s.win = e.win), m as (select sum(score * population) / sum(population) as mean from v where win = 'usual')
select cell, win, round(case when mean > 0 then 100 * score / mean end, 6) as idx from v, m
""", (263, 494))
def gravity_index_to_usual_window(t):
    weights = t.destinations().select(F.col("id").alias("destination"), "weight")
    s = gravity.score(t.pairs(windows=True).filter("mode = 'pt'"), weights, gravity.impedance(F.col("minutes"), "exponential", 0.05), ["origin", "win"]).withColumnRenamed("origin", "cell")
    v = measures.for_every_cell(t.cells(), ["usual", "saturday"], s, "win", ["score"]).select("cell", "win", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"), "population")
    return gravity.index_to_mean(v, "score", "population", of=v.filter("win = 'usual'")).select("cell", "win", F.round("idx", 6).alias("idx"))


@query("cells pairs destinations", "with " + _SQL_SCORE + """, m as (select service, sum(score * population) / nullif(sum(population), 0) as mean from v group by service),
i as (select cell, service, round(case when mean > 0 then 100 * score / mean end, 6) as idx from v join m using (service) where service in ('Brand#1', 'Brand#2', 'Brand#3'))
select cell, count(idx) as members, case when count(idx) = 3 then round(avg(idx), 6) end as idx from i group by cell
""", (263,))
def gravity_group_index(t):
    group = ["Brand#1", "Brand#2", "Brand#3"]
    i = gravity.index_to_mean(_scored(t), "score", "population", ["service"]).filter(F.col("service").isin(group)).select("cell", F.round("idx", 6).alias("idx"))
    return i.groupBy("cell").agg(F.count("idx").alias("members"), F.when(F.count("idx") == len(group), F.round(F.avg("idx"), 6)).alias("idx"))
