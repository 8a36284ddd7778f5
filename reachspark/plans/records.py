"""Queries on hand-kept tables, packed numbers, dates, layers and comparisons of builds."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachspark.functions import text
from reachspark.operators import measures, spatial, stats
from reachspark.plans import fares as fare_plans
from reachspark.plans.registry import query
from reachspark.sources import readers, sinks


@query("destinations", """
with recursive p as (select a.id as u, b.id as v from destinations a join destinations b on a.service = b.service and a.id <> b.id and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 900),
r(node, root) as (select u, u from p union select p.v, r.root from r join p on p.u = r.node where r.root < p.v),
c as (select node, min(root) as root from r group by node)
select id, service, name, dropped from (select id, service, name, row_number() over (partition by coalesce(root, id) order by name, id) as k, count(*) over (partition by coalesce(root, id)) - 1 as dropped from destinations left join c on id = node) where k = 1
""", (201, 177), recursive=True)
def survivors(t):
    """Of places of one service that are linked within the distance, the first by name stays."""
    d = t.destinations().select("id", "service", "name", "x", "y")
    linked = spatial.linked(d, "id", ["service"], 900.0)
    groups = d.join(linked, F.col("id") == F.col("node"), "left").groupBy(F.coalesce("root", "id").alias("root"))
    return groups.agg(F.min(F.struct("name", "id", "service")).alias("first"), (F.count("*") - 1).alias("dropped")).select("first.id", "first.service", "first.name", "dropped")


@query("pairs", """
select origin, destination, mode, cast(round_even(minutes / 2, 0) as smallint) as halves, round_even(minutes / 8, 2) as eighths, cast(minutes as tinyint) as minutes, case when minutes < 40 then 60 / (40 - minutes) end is null as lost from pairs
""", (67, 68, 509))
def packed_numbers(t):
    """Minutes as whole numbers and decimals rounded half to even, in narrow types; what is not finite is null."""
    m = F.col("minutes")
    pace = F.when(m >= 40, F.lit(float("inf"))).otherwise(60 / F.nullif((40 - m).cast("double"), F.lit(0.0)))
    return t.pairs().select("origin", "destination", "mode", F.bround(m / 2, 0).cast("smallint").alias("halves"), sinks.clean(m / 8, 2).alias("eighths"), m.cast("tinyint").alias("minutes"), sinks.clean(pace).isNull().alias("lost"))


@query("", """
with r as (select event_id, case event_id % 4 when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S') when 1 then strftime(ts, '%d/%m/%Y') when 2 then '2024-13-45' else '' end as said from events)
select event_id, case when regexp_matches(said, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') then substr(said, 1, 10) end as iso, strftime(try_cast(substr(said, 1, 10) as date), '%Y-%m-%d') as day from r
""", (450, 451))
def snapshot_dates(t):
    """The first ten characters of what looks like a date, and the date if there is such a day."""
    k = F.col("event_id") % 4
    said = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.date_format("ts", "dd/MM/yyyy")).when(k == 2, "2024-13-45").otherwise("")
    rows = t.raw("events").select("event_id", said.alias("said"))
    iso = text.iso_day(F.col("said"))
    return rows.select("event_id", iso.alias("iso"), F.date_format(iso.try_cast("date"), "yyyy-MM-dd").alias("day"))


@query("reach schools", """
select school, kind, round(sum(case when minutes <= 15 then 1 + cell % 3 else 0 end) / sum(1 + cell % 3), 6) as share, cast(sum(1 + cell % 3) as bigint) as weight from reach join schools using (school) group by school, kind
""", (278,))
def school_share_within(t):
    w = 1 + F.col("cell") % 3
    rows = t.reach().join(t.schools().select("school", "kind"), "school")
    return rows.groupBy("school", "kind").agg(F.round(stats.share(F.col("minutes") <= 15, w.cast("double")), 6).alias("share"), F.sum(w).alias("weight"))


def _hand_kept(t):
    """A table as people keep it: some rows without a name or a day, some with a point, some that keep the point."""
    k = F.col("s_suppkey")
    return t.raw("supplier").filter(k % 3 != 0).select(
        k.alias("school"), F.when(k % 5 != 0, F.lit("kim")).otherwise(F.lit(" ")).alias("checked_by"), F.when(k % 7 != 0, F.lit("2024-01-01")).alias("checked_on"),
        F.when(k % 2 == 0, (k % 90).cast("double")).alias("lon"), F.when(k % 2 == 0, (k % 45).cast("double")).alias("lat"), F.when(k % 11 == 0, F.lit("rule")).otherwise(F.lit("point")).alias("what"),
    )


_KEPT = """kept as (select s_suppkey as school, case when s_suppkey % 2 = 0 then cast(s_suppkey % 90 as double) end as lon, case when s_suppkey % 2 = 0 then cast(s_suppkey % 45 as double) end as lat, s_suppkey % 11 = 0 as rule
  from supplier where s_suppkey % 3 <> 0 and s_suppkey % 5 <> 0 and s_suppkey % 7 <> 0)"""


@query("schools", "with " + _KEPT + """
select school, coalesce(kept.lon, schools.x) as x, coalesce(kept.lat, schools.y) as y, case when kept.school is null then 'unchecked' when rule then 'rule' when kept.lon is null then 'kept' else 'moved' end as label from schools left join kept using (school)
""", (11, 27, 28, 29, 182))
def checked_points(t):
    """Points of schools, moved where someone has checked them on a day, with what was decided."""
    kept = readers.checked_rows(_hand_kept(t)).select(F.col("school").alias("k"), "lon", "lat", "what")
    label = F.when(F.col("k").isNull(), "unchecked").when(F.col("what") == "rule", "rule").when(F.col("lon").isNull(), "kept").otherwise("moved")
    return t.schools().join(kept, F.col("school") == F.col("k"), "left").select("school", F.coalesce("lon", "x").alias("x"), F.coalesce("lat", "y").alias("y"), label.alias("label"))


@query("schools", """
select school, case when school % 6 = 0 then 'boys' else sex end as sex, case when school % 6 = 3 then 'special' else kind end as kind from schools
""", (30, 32))
def checked_attributes(t):
    """Checked values, a row for each school and field, in place of the schools' own."""
    s = t.schools().select("school", "sex", "kind")
    table = s.filter("school % 3 = 0").select("school", F.when(F.col("school") % 6 == 0, "sex").otherwise("kind").alias("field"), F.when(F.col("school") % 6 == 0, "boys").otherwise("special").alias("value"))
    return readers.overrides(s, table, "school", ["sex", "kind"])


@query("schools", """
with e as (select school, cast(n as int) as pos, x + n as lon, y - n as lat from schools, (select unnest(generate_series(1, 3)) as n) where school % 4 = 0 and n <= 1 + school % 3)
select school, pos, lon, lat from e union all select school, 0, x, y from schools where school not in (select school from e)
""", (31, 183))
def routing_points(t):
    """A row for each entrance of a school in order, or for its one point."""
    s = t.schools().select("school", F.col("x").alias("lon"), F.col("y").alias("lat"))
    table = s.filter("school % 4 = 0").select("school", F.explode(F.sequence(F.lit(1), (1 + F.col("school") % 3).cast("int"))).alias("pos"), "lon", "lat").select("school", "pos", (F.col("lon") + F.col("pos")).alias("lon"), (F.col("lat") - F.col("pos")).alias("lat"))
    return readers.entrances(s, table, "school")


@query("destinations", "select kind, array_to_string(list_sort(list(distinct service)), '|') as services from destinations group by kind", (98,))
def type_services(t):
    """For each type the services that count it."""
    return t.destinations().groupBy("kind").agg(F.array_join(F.array_sort(F.collect_set("service")), "|").alias("services"))


@query("schools", "select school, greatest(years_from, case when school % 2 = 0 then 7 end) as entry, years_from is null and school % 2 = 1 as unknown from schools", (106,))
def entry_years(t):
    """The later of the service's first year and the school's; null only if both are."""
    first = F.when(F.col("school") % 2 == 0, 7)
    return t.schools().select("school", F.greatest("years_from", first).alias("entry"), (F.col("years_from").isNull() & first.isNull()).alias("unknown"))


_LAYERS = """layer as (select origin as cell, min(minutes) filter (where zones <= 0) as m0, min(minutes) filter (where zones <= 1) as m1, min(minutes) filter (where zones <= 2) as m2, min(minutes) filter (where zones <= 3) as m3, min(minutes) filter (where zones <= 4) as m4, min(minutes) as unpriced from zoned group by origin)"""


@query("cells pairs", "with " + fare_plans._ZONED + ", " + _LAYERS + """
select cell, cast(cell % 7 as int) as zones, case least(cell % 7, 5) when 0 then m0 when 1 then m1 when 2 then m2 when 3 then m3 when 4 then m4 else unpriced end as minutes from cells left join layer using (cell)
""", (426, 427), recursive=True)
def priced_layer(t):
    """Each cell's times at the zones that it can pay for; beyond the cap the unpriced time."""
    layers = [F.min(F.when(F.col("zones") <= z, F.col("minutes"))) for z in range(fare_plans.CAP + 1)]
    own = fare_plans._zoned(t).groupBy(F.col("origin").alias("cell")).agg(F.array(*layers, F.min("minutes")).alias("layers"))
    pays = (F.col("cell") % 7).cast("int")
    return t.cells().select("cell").join(own, "cell", "left").select("cell", pays.alias("zones"), F.col("layers")[F.least(pays, F.lit(fare_plans.CAP + 1))].alias("minutes"))


@query("", "with recursive " + fare_plans._HOPS + f""" select a as zone, b as destination, cast(zones as int) as zones, round(({fare_plans._PRICES})[zones] * 2, 6) as cost, case when a % 2 = 0 then 0.0::double else round(({fare_plans._PRICES})[zones] * 2, 6) end as class_cost from hops""", (417, 439, 440))
def zone_costs(t):
    """What a return trip between any two zones costs, and for a class that travels free from even zones."""
    from reachspark.operators import fares

    prices = F.array(*[F.lit(p) for p in fare_plans.PRICES])
    cost = F.round(fares.fare(prices, F.col("zones"), fare_plans.CAP) * 2, 6)
    hops = fares.zone_distance(fare_plans._edges(t), fare_plans.CAP)
    return hops.select(F.col("a").alias("zone"), F.col("b").alias("destination"), "zones", cost.alias("cost"), F.when(F.col("a") % 2 == 0, 0.0).otherwise(cost).alias("class_cost"))


@query("cells pairs", """
with n as (select cell as origin, count(*) filter (where minutes <= 10) as n10, count(*) filter (where minutes <= 15) as n15, count(*) filter (where minutes <= 20) as n20, count(*) filter (where minutes <= 30) as n30 from cells left join pairs on origin = cell group by cell)
select origin, cast(5 + origin % 40 as int) as standard, case when origin % 40 < 10 then n10 when origin % 40 < 15 then n15 when origin % 40 < 25 then n20 else n30 end as n from n
""", (322,))
def count_at_step(t):
    """Counts at the largest step that each cell's own standard allows, the first below it."""
    standard = (5 + F.col("origin") % 40).cast("int")
    steps = measures.counts_within(t.cells().select(F.col("cell").alias("origin")).join(t.pairs(), "origin", "left"), ["origin"])
    pick = F.col(f"n{measures.STEPS[0]}")
    for s in measures.STEPS[1:]:
        pick = F.when(standard >= s, F.col(f"n{s}")).otherwise(pick)
    return steps.select("origin", standard.alias("standard"), pick.alias("n"))


@query("cells", """
with s as (select sa2, count(*) as n, count(*) filter (where zone = 1) as inside, sum(population) as people, sum(case when zone = 1 then population else 0 end) as masked from cells group by sa2)
select sa2, round(people, 2) as people, round(masked, 2) as masked, round(inside / n, 6) as share, inside > 0 and inside < 0.98 * n as partial from s
""", (338, 386, 387))
def area_mask(t):
    """People of each suburb inside an area, and whether the suburb is only partly in it."""
    inside = F.col("zone") == 1
    s = t.cells().groupBy("sa2").agg(F.count("*").alias("n"), F.count_if(inside).alias("inside"), F.sum("population").alias("people"), F.sum(F.when(inside, F.col("population")).otherwise(0.0)).alias("masked"))
    return s.select("sa2", F.round("people", 2).alias("people"), F.round("masked", 2).alias("masked"), F.round(F.col("inside") / F.col("n"), 6).alias("share"), ((F.col("inside") > 0) & (F.col("inside") < 0.98 * F.col("n"))).alias("partial"))


_BUILDS = """b as (select cell, council, population, min(minutes) filter (where mode <> 'walk') as before, min(minutes) filter (where mode <> 'pt') as after from cells left join pairs on cell = origin group by all)"""


@query("cells pairs", "with " + _BUILDS + """
select council, round(sum(case when before <= 5 then population else 0 end) / nullif(sum(population), 0), 6) as share_before, round(sum(case when after <= 5 then population else 0 end) / nullif(sum(population), 0), 6) as share_after,
  count(*) filter (where before is distinct from after) as changed, round(sum(case when before is distinct from after then population else 0 end), 2) as people,
  cast(round(100 * (sum(case when after <= 5 then population else 0 end) - sum(case when before <= 5 then population else 0 end)) / nullif(sum(population), 0)) as int) as points from b group by council
""", (300, 344))
def compare_builds(t):
    """Two builds cell by cell, null-safe: shares before and after, cells and people that change, the difference in whole points."""
    of = lambda skip: F.min(F.when(F.col("mode") != skip, F.col("minutes")))
    best = t.pairs().groupBy(F.col("origin").alias("cell")).agg(of("walk").alias("before"), of("pt").alias("after"))
    rows = t.cells().select("cell", "council", "population").join(best, "cell", "left")
    differs = ~F.col("before").eqNullSafe(F.col("after"))
    w = F.col("population")
    met = lambda c: F.sum(F.when(F.col(c) <= 5, w).otherwise(0.0))
    total = F.nullif(F.sum(w), F.lit(0.0))
    return rows.groupBy("council").agg(F.round(met("before") / total, 6).alias("share_before"), F.round(met("after") / total, 6).alias("share_after"), F.count_if(differs).alias("changed"), F.round(F.sum(F.when(differs, w).otherwise(0.0)), 2).alias("people"), F.round(100 * (met("after") - met("before")) / total).cast("int").alias("points"))


@query("", """
select l_suppkey as way, round(sum(case when l_quantity < 10 then l_extendedprice else 0 end) / sum(l_extendedprice), 6) as narrow, cast(count(*) filter (where l_returnflag = 'A') as bigint) as lowered, cast(count(*) filter (where l_returnflag = 'R') as bigint) as raised,
  round(sum(case when l_linestatus = 'O' then l_extendedprice else 0 end), 2) as lit from lineitem group by l_suppkey
""", (435, 436, 437))
def street_figures(t):
    """For each way the share that is narrower than a limit, its kerbs by kind, and how much of it is lit."""
    length = F.col("l_extendedprice")
    part = lambda c: F.sum(F.when(c, length).otherwise(0.0))
    return t.raw("lineitem").groupBy(F.col("l_suppkey").alias("way")).agg(F.round(part(F.col("l_quantity") < 10) / F.sum(length), 6).alias("narrow"), F.count_if(F.col("l_returnflag") == "A").alias("lowered"), F.count_if(F.col("l_returnflag") == "R").alias("raised"), F.round(part(F.col("l_linestatus") == "O"), 2).alias("lit"))


@query("", """
with piece as (select o_custkey as piece, o_orderkey as point from orders)
select point, piece, round(greatest(c_acctbal, 0) / count(*) over (partition by piece), 6) as people from piece join customer on piece = c_custkey
""", (213,))
def sampled_points(t):
    """People of a piece shared equally over its points."""
    points = t.raw("orders").select(F.col("o_custkey").alias("piece"), F.col("o_orderkey").alias("point"))
    n = points.groupBy("piece").agg(F.count("*").alias("n")).join(t.raw("customer").select(F.col("c_custkey").alias("piece"), F.greatest("c_acctbal", F.lit(0.0)).alias("people")), "piece")
    return points.join(n, "piece").select("point", "piece", F.round(F.col("people") / F.col("n"), 6).alias("people"))


@query("schools", """
select area, count(*) as platforms, round(coalesce(max(case when school % 10 = 0 then x end), avg(x)), 6) as x, round(coalesce(max(case when school % 10 = 0 then y end), avg(y)), 6) as y from schools group by area having count(*) >= 2
""", (241, 129))
def station_points(t):
    """Stations of two platforms or more, at their own point or the mean of the platforms."""
    at = lambda c: F.round(F.coalesce(F.max(F.when(F.col("school") % 10 == 0, F.col(c))), F.avg(c)), 6).alias(c)
    return t.schools().groupBy("area").agg(F.count("*").alias("platforms"), at("x"), at("y")).filter("platforms >= 2")


@query("schools", """
with s as (select school, case when not zoned then 'none' when years_from is null then 'unclear' else 'mapped' end as status from schools where school % 4 <> 0)
select school, name, coalesce(status, 'unlisted') as status, coalesce(school % 4 <> 0 and not zoned and kind <> 'private', false) as to_check from schools left join s using (school)
""", (62, 130, 131, 172))
def annotated_schools(t):
    """The list with columns of a status table that lacks some, defaults in their place, and what is still to be looked at."""
    listed = t.schools()
    state = listed.filter("school % 4 != 0").select(F.col("school").alias("k"), F.when(~F.col("zoned"), "none").when(F.col("years_from").isNull(), "unclear").otherwise("mapped").alias("status"))
    both = listed.join(state, F.col("school") == F.col("k"), "left")
    return both.select("school", "name", F.coalesce("status", F.lit("unlisted")).alias("status"), (F.col("k").isNotNull() & ~F.col("zoned") & (F.col("kind") != "private")).alias("to_check"))


@query("schools", """
with c as (select school, case school % 3 when 0 then 'one:' || cast(school as varchar) when 1 then kind else 'one:x' end as said from schools)
select school, case when regexp_matches(said, '^one:[0-9]+$') then 'one' when said in ('state', 'integrated') then said else 'all' end as choice, cast(nullif(regexp_extract(said, '^one:([0-9]+)$', 1), '') as bigint) as of from c
""", (459,))
def read_choices(t):
    """A choice as text: one school by number, a kind, or what stands for anything else."""
    said = F.when(F.col("school") % 3 == 0, F.concat(F.lit("one:"), F.col("school").cast("string"))).when(F.col("school") % 3 == 1, F.col("kind")).otherwise("one:x")
    choice, of = text.choice(said, ["state", "integrated"], "all")
    return t.schools().select("school", choice.alias("choice"), of.alias("of"))


@query("cells", "select nzdep, cast((nzdep + 1) // 2 as int) as fifth, count(*) as cells, round(sum(population), 2) as people from cells group by nzdep", (359,))
def fifths(t):
    """Deprivation tenths and the fifths that hold them."""
    return t.cells().groupBy("nzdep").agg(F.count("*").alias("cells"), F.round(F.sum("population"), 2).alias("people")).withColumn("fifth", F.expr("cast((nzdep + 1) div 2 as int)"))
