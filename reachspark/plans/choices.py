"""Queries on school choice and zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachspark.operators import choices
from reachspark.plans.registry import query

_OK = "kind <> 'private' and medium = 'english' and (sex = 'co-ed' or sex = 'girls') and coalesce(years_from <= 8 and years_to >= 7, true)"


@query("schools", "select school, kind, sex, medium from schools where " + _OK, (90, 91, 92, 94, 95, 118, 119))
def school_eligible(t):
    return t.schools().filter(choices.eligible("state", "girls", (7, 8))).select("school", "kind", "sex", "medium")


@query("reach", "select cell, school, mode, minutes, metres, row_number() over (partition by cell, mode order by minutes, metres, school) as place from reach", (153, 360, 482))
def ordered_reach(t):
    return choices.ordered_reach(t.reach(), ["cell", "mode"]).withColumn("place", F.col("place").cast("long"))


@query("reach", """
with r as (select *, rank() over (partition by cell, mode order by minutes) as k, row_number() over (partition by cell, mode order by minutes, metres, school) as place from reach)
select cell, mode, min(minutes) as minutes, arg_min(school, place) as school, array_to_string(list(school order by place)[2:], ',') as ties from r where k = 1 group by cell, mode
""", (361, 366, 367, 190, 468))
def nearest_ties(t):
    n = choices.nearest_with_ties(t.reach(), ["cell", "mode"])
    return n.withColumn("ties", F.array_join("ties", ","))


@query("cells reach schools", """
with r as (select cell, mode, minutes, sex, years_from, years_to from reach join schools using (school) where kind <> 'private' and medium = 'english'),
g as (select cell, student, stage, min(minutes) filter (where mode = 'pt') as pt, min(minutes) as best
  from r, (values ('girls'), ('boys')) s(student), (values (1, 6), (7, 8)) y(low, high), lateral (select low as stage) where (sex = 'co-ed' or sex = student) and coalesce(years_from <= high and years_to >= low, true) group by all)
select cell, case when count(pt) = 4 then max(pt) end as pt, case when count(best) = 4 then max(best) end as best from (select cell from cells) left join g using (cell) group by cell
""", (467, 472, 469, 471, 474))
def choice_times(t):
    r = t.reach().join(t.schools(), "school")
    groups = F.array(*[F.when(choices.eligible("state", s, y), F.struct(F.lit(s).alias("student"), F.lit(y[0]).alias("stage"))) for s in ("girls", "boys") for y in ((1, 6), (7, 8))])
    g = r.select("cell", "mode", "minutes", F.explode(F.array_compact(groups)).alias("g"))
    g = g.groupBy("cell", "g").agg(F.min(F.when(F.col("mode") == "pt", F.col("minutes"))).alias("pt"), F.min("minutes").alias("best"))
    return t.cells().select("cell").join(g, "cell", "left").groupBy("cell").agg(choices.slowest(F.col("pt"), 4).alias("pt"), choices.slowest(F.col("best"), 4).alias("best"))


@query("reach schools", """
with r as (select reach.*, kind <> 'private' and medium = 'english' as state, zoned from reach join schools using (school)), b as (
  select *, min(minutes) over (partition by cell) as a, min(minutes) filter (where state) over (partition by cell) as s, min(minutes) filter (where zoned) over (partition by cell) as z from r)
select cell, school, mode, minutes from b where minutes = a or (state and minutes = s) or (zoned and minutes = z)
""", (363,))
def short_list(t):
    r = t.reach().join(t.schools().select("school", "kind", "medium", "zoned"), "school")
    state = (F.col("kind") != "private") & (F.col("medium") == "english")
    return choices.short_list(r, ["cell"], {"all": F.lit(True), "state": state, "zone": F.col("zoned")}).select("cell", "school", "mode", "minutes")


@query("schools", """
select school, case when not zoned then 'none' when school % 4 = 0 then 'no_map' when years_from is null then 'unclear_years' when date '2024-01-01' + cast(school % 90 as int) > date '2024-02-01' then 'upcoming' else 'in_force' end as status from schools
""", (107, 108))
def zone_status(t):
    dated = F.when(F.col("school") % 4 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("school") % 90).cast("int")))
    s = choices.zone_status(F.col("years_from"), dated, F.lit("2024-02-01").cast("date"))
    return t.schools().select("school", F.when(~F.col("zoned"), "none").otherwise(s).alias("status"))


@query("reach", """
with s as (select cell, mode, list_sort(list(distinct school % 5)) as zones, sum(minutes) as w, max(case when school % 5 = cell % 5 then 1 else 0 end) as home from reach group by cell, mode),
g as (select cell, zones, round(sum(w), 9) as w, max(home) as home from s group by cell, zones), r as (select *, row_number() over (partition by cell order by w desc, home desc, len(zones), zones) as k, count(*) over (partition by cell) > 1 as split from g)
select cell, array_to_string(zones, '+') as zones, cast(w as double) as w, split from r where k = 1
""", (283,))
def majority_zone_set(t):
    s = t.reach().groupBy("cell", "mode").agg(F.array_sort(F.collect_set(F.col("school") % 5)).alias("zones"), F.sum("minutes").cast("double").alias("w"), F.max(F.when(F.col("school") % 5 == F.col("cell") % 5, 1).otherwise(0)).alias("home"))
    return choices.majority_set(s, "cell", "zones", "w", "home").withColumn("zones", F.array_join("zones", "+"))


@query("schools", """
select area, count(*) as schools, count(*) filter (where kind = 'state') as state, count(*) filter (where kind = 'private') as private, count(*) filter (where sex = 'girls') as girls, count(*) filter (where medium = 'maori') as maori, count(*) filter (where zoned) as zoned from schools group by area
""", (275, 276, 323))
def counting_line(t):
    n = lambda c, name: F.count_if(c).alias(name)
    return t.schools().groupBy("area").agg(F.count("*").alias("schools"), n(F.col("kind") == "state", "state"), n(F.col("kind") == "private", "private"), n(F.col("sex") == "girls", "girls"), n(F.col("medium") == "maori", "maori"), n(F.col("zoned"), "zoned"))


@query("schools", """
select area, bool_or((years_from <= 6 and years_to >= 1) <> (years_from <= 8 and years_to >= 7)) as staged from schools group by area
""", (93, 477, 481))
def stage_split(t):
    meets = lambda low, high: (F.col("years_from") <= high) & (F.col("years_to") >= low)
    return t.schools().groupBy("area").agg(F.bool_or(meets(1, 6) != meets(7, 8)).alias("staged"))


@query("schools", """
with s as (select school, name, list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: w <> '') as words from schools), r as (
  select school, name, cast(case when list_contains(words, 'supplier') then 3 end + 1 + case when list_contains(words, '000000004') then 3 when len(list_filter(words, lambda w: starts_with(w, '00000000'))) > 0 then 2 when contains(name, '00000000') then 1 end as int) as score from s)
select school, name, score from r where score is not null order by score desc, school limit 8
""", (372, 460))
def school_search(t):
    s = F.expr("1")
    score = choices.name_score(F.col("name"), "supplier") + F.when(choices.name_score(F.col("name"), "000000004") == 3, 3).otherwise(choices.name_score(F.col("name"), "00000000"))
    return t.schools().select("school", "name", (score * s).cast("int").alias("score")).filter("score is not null").orderBy(F.desc("score"), "school").limit(8)


@query("reach schools", """
select school, notes, kind from (select school, kind, case when kind = 'private' then 'private' when medium <> 'english' then 'medium' when sex <> 'co-ed' then 'sex' when not zoned then 'zone' end as notes from schools) where notes is not null
""", (141,))
def not_counted_reason(t):
    why = F.when(F.col("kind") == "private", "private").when(F.col("medium") != "english", "medium").when(F.col("sex") != "co-ed", "sex").when(~F.col("zoned"), "zone")
    return t.schools().select("school", why.alias("notes"), "kind").filter("notes is not null")


@query("cells reach", """
select cell, count(*) filter (where minutes <= 10) as n10, count(*) filter (where minutes <= 20) as n20, case when count(minutes) = 0 then 'none' when bool_and(minutes >= 2) then 'far' else 'near' end as verdict
from (select cell from cells) left join (select cell, school, min(minutes) as minutes from reach group by all) using (cell) group by cell
""", (329,))
def choices_within(t):
    best = t.reach().groupBy("cell", "school").agg(F.min("minutes").alias("minutes"))
    return t.cells().select("cell").join(best, "cell", "left").groupBy("cell").agg(F.count_if(F.col("minutes") <= 10).alias("n10"), F.count_if(F.col("minutes") <= 20).alias("n20"), F.when(F.count("minutes") == 0, "none").when(F.bool_and(F.col("minutes") >= 2), "far").otherwise("near").alias("verdict"))
