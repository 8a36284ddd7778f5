"""Queries on zone statuses, payment by the hour, class edges, chains of areas and lists for download."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from reachspark.operators import areas, choices, fares, measures, shapes, zones
from reachspark.plans.registry import query

DAY = datetime.date(1999, 6, 30)
FIRST = {"primary": 1, "intermediate": 7, "secondary": 9}

_LISTED = """listed as (select school, name, zoned as scheme, kind <> 'private' and medium = 'english' as counted, years_from, case school % 3 when 0 then ['primary'] when 1 then ['primary', 'intermediate'] else ['secondary'] end as services from schools),
maps as (select school, polygon, day, case when school % 9 = 3 and polygon % 2 = 0 then 1 when school % 9 = 6 then 9 end as years_from, case when school % 9 = 3 and polygon % 2 = 0 then 8 when school % 9 = 6 then 13 end as years_to from zone_maps where school % 10 <> 9 and (school % 4 <> 0 or day > date '1999-06-30')),
dates as (select school, count(*) filter (where day is null or day <= date '1999-06-30') as now, max(day) filter (where day <= date '1999-06-30') as last, count(*) filter (where day is null) as unknown, min(day) filter (where day > date '1999-06-30') as next from maps group by school),
base as (select l.*, d.*, d.school is not null as has_map, case when d.school is null then case when scheme then 'no_map' else 'none' end when not scheme then case when now > 0 then 'not_applied' else 'none' end when now > 0 then 'in_force' else 'upcoming_used' end as first_status, l.school as s from listed l left join dates d on d.school = l.school),
used as (select b.s, b.services, b.years_from as entry, m.polygon, m.years_from, m.years_to from base b join maps m on m.school = b.s where first_status = 'in_force' and (m.day is null or m.day <= date '1999-06-30') or first_status = 'upcoming_used' and m.day = b.next),
mixed as (select s, count(*) filter (where years_from is null) > 0 and count(*) filter (where years_from is not null) > 0 as mixed from used group by s),
each as (select s, service, polygon from (select *, unnest(services) as service from used) where years_from is null or greatest(case service when 'primary' then 1 when 'intermediate' then 7 else 9 end, coalesce(entry, 0)) between years_from and years_to),
of_ as (select s, count(distinct service) as served, count(*) as n from (select distinct * from each) group by s),
status as (select b.s as school, case when first_status in ('in_force', 'upcoming_used') and (mixed or coalesce(served, 0) < len(services)) then 'unclear_years' else first_status end as status,
  case first_status when 'in_force' then last when 'upcoming_used' then next end as "from", case when first_status = 'in_force' or first_status = 'none' and has_map then next end as next_from, case when first_status = 'not_applied' then last end as map_from, first_status = 'in_force' and unknown > 0 as date_unknown,
  case when first_status in ('in_force', 'upcoming_used') and not mixed and coalesce(served, 0) = len(services) then n else 0 end as polygons, services, counted, name from base b left join mixed on mixed.s = b.s left join of_ on of_.s = b.s)"""


def _listed(t):
    k = F.col("school")
    services = F.when(k % 3 == 0, F.array(F.lit("primary"))).when(k % 3 == 1, F.array(F.lit("primary"), F.lit("intermediate"))).otherwise(F.array(F.lit("secondary")))
    return t.schools().select("school", "name", F.col("zoned").alias("scheme"), services.alias("services"), "years_from", ((F.col("kind") != "private") & (F.col("medium") == "english")).alias("counted"))


def _status(t):
    k, p = F.col("school"), F.col("polygon")
    low = F.when((k % 9 == 3) & (p % 2 == 0), 1).when(k % 9 == 6, 9)
    high = F.when((k % 9 == 3) & (p % 2 == 0), 8).when(k % 9 == 6, 13)
    maps = t.zone_maps().filter((k % 10 != 9) & ((k % 4 != 0) | (F.col("day") > F.lit(DAY)))).select("school", "polygon", "day", low.alias("years_from"), high.alias("years_to"))
    return zones.statuses(_listed(t), maps, DAY, FIRST)


@query("schools zone_maps", "with " + _LISTED + ' select school, status, "from", next_from, map_from, date_unknown, cast(polygons as bigint) as polygons from status', (107, 108))
def zone_statuses(t):
    """The zone of every school on a day: in force, upcoming, unclear or none, and how many polygons its services use."""
    used = F.aggregate(F.map_values("polygons"), F.lit(0), lambda s, x: s + F.size(x))
    return _status(t).select("school", "status", "from", "next_from", "map_from", "date_unknown", used.cast("long").alias("polygons"))


@query("schools zone_maps", "with " + _LISTED + """, s as (select unnest(services) as service, status from status where counted)
select service, count(*) as schools, count(*) filter (where status = 'in_force') as in_force, count(*) filter (where status = 'upcoming_used') as upcoming_used, count(*) filter (where status = 'none') as "none", count(*) filter (where status = 'no_map') as no_map,
  count(*) filter (where status = 'not_applied') as not_applied, count(*) filter (where status = 'unclear_years') as unclear_years, count(*) filter (where status in ('in_force', 'upcoming_used')) as zoned, count(*) filter (where status = 'none') as "open" from s group by service
""", (279, 324))
def zone_tally(t):
    """State schools taught in English by the status of their zones, for each service."""
    return zones.tally(_status(t), _listed(t).filter("counted"))


@query("schools zone_maps", "with " + _LISTED + """
select case when status = 'upcoming_used' then "from" else next_from end as "from", school, name, status = 'upcoming_used' as applied, counted from status where status = 'upcoming_used' or next_from is not null
""", (282,))
def zones_upcoming(t):
    """Zones that start after the day."""
    return zones.upcoming(_status(t), _listed(t).select("school", "name", "counted")).join(_listed(t).select("school", "counted"), "school")


# Prices by profile, way of paying and zones.
_PRICE = {("adult", "cash"): 4.0, ("adult", "hop_peak"): 2.2, ("adult", "hop_offpeak"): 1.98, ("child", "hop_peak"): 1.3, ("child", "hop_offpeak"): 1.17, ("student", "pass"): 1.8}
_FREE = {"infant": None, "gold": fares.free_hours({"free_from": "09:00", "free_until": "15:00", "free_after": "18:30"})}
_OFFPEAK = [(0.0, 7.0), (9.0, 15.0), (19.0, 24.0)]
_PRICES_SQL = "(values " + ", ".join(f"('{p}', '{k}', {z}, {round(v * (1 + 0.5 * (z - 1)), 4)}::double)" for (p, k), v in _PRICE.items() for z in range(1, 5)) + ") prices(profile, key, zones, price)"


@query("", f"""
with ride as (select event_id, hour(ts) + minute(ts) / 60.0::double as hour, isodow(ts) <= 5 as weekday, ['adult', 'child', 'gold', 'infant', 'student'][event_id % 5 + 1] as profile, ['cash', 'hop', 'pass'][user_id % 3 + 1] as payment, cast(1 + user_id % 6 as int) as zones from events),
timed as (select *, not weekday or hour < 7 or hour >= 9 and hour < 15 or hour >= 19 as offpeak from ride), keyed as (select *, case when payment = 'hop' then case when offpeak then 'hop_offpeak' else 'hop_peak' end else payment end as key,
  profile = 'infant' or profile = 'gold' and (not weekday or hour >= 9 and hour < 15 or hour >= 18.5) as free from timed)
select event_id, offpeak, k.key as key, free, case when free then 0 else coalesce((select price from {_PRICES_SQL} where prices.profile = k.profile and prices.key = k.key and prices.zones = least(k.zones, 4)), (select price from {_PRICES_SQL} where prices.profile = 'adult' and prices.key = k.key and prices.zones = least(k.zones, 4)),
  (select min(row(prices.key, price))[2] from {_PRICES_SQL} where prices.profile = k.profile and prices.zones = least(k.zones, 4)), (select min(row(prices.key, price))[2] from {_PRICES_SQL} where prices.profile = 'adult' and prices.zones = least(k.zones, 4))) end as fare from keyed k
""", (113, 114, 115, 116))
def fare_by_hour(t):
    """What each ride costs: the price column of its way of paying at that hour, the profile's price or the adult's, nothing in free hours."""
    of = lambda c, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (c % len(v) + 1).cast("int"))
    rides = t.raw("events").select("event_id", (F.hour("ts") + F.minute("ts") / 60.0).alias("hour"), (F.weekday("ts") < 5).alias("weekday"), of(F.col("event_id"), "adult", "child", "gold", "infant", "student").alias("profile"), of(F.col("user_id"), "cash", "hop", "pass").alias("payment"), (1 + F.col("user_id") % 6).cast("int").alias("zones"))
    rides = rides.withColumn("offpeak", fares.is_offpeak(_OFFPEAK, F.col("hour"), F.col("weekday")))
    rides = rides.withColumn("key", fares.payment_key(sorted({k for _, k in _PRICE}), F.col("payment"), F.col("offpeak"))).withColumn("free", fares.free_travel(_FREE, F.col("profile"), F.col("hour"), F.col("weekday")))
    prices = t.spark.createDataFrame([(p, k, z, round(v * (1 + 0.5 * (z - 1)), 4)) for (p, k), v in _PRICE.items() for z in range(1, 5)], "profile string, key string, zones int, price double")
    return fares.priced(rides, prices, 4).select("event_id", "offpeak", "key", "free", F.when(F.col("free"), 0.0).otherwise(F.col("fare")).alias("fare"))


_NICE = "[1, 2, 5, 10, 15, 20, 25, 30, 40, 50, 75, 100, 150, 200, 250, 300, 400, 500]::double[]"


def _edge(q: str) -> str:
    return f"coalesce(list_filter({_NICE}, lambda n: n >= {q})[1], ceil({q}))"


@query("cells pairs", f"""
with n as (select sa2, cell, (select count(*) from pairs p where p.origin = c.cell and minutes <= 20) * (case when cell % 3 = 0 then 0 else 1 end) as reached from cells c),
v as (select sa2, list(cast(reached as double) order by reached, cell) as v from n where reached > 0 group by sa2),
q as (select sa2, v[cast(least(floor(len(v) * 0.25), len(v) - 1) as bigint) + 1] as a, v[cast(least(floor(len(v) * 0.5), len(v) - 1) as bigint) + 1] as b, v[cast(least(floor(len(v) * 0.75), len(v) - 1) as bigint) + 1] as c from v),
e1 as (select *, {_edge("a")} as x from q), e2 as (select *, case when {_edge("b")} <= x then list_filter({_NICE}, lambda n: n > x)[1] else {_edge("b")} end as y from e1), e3 as (select *, case when {_edge("c")} <= y then list_filter({_NICE}, lambda n: n > y)[1] else {_edge("c")} end as z from e2)
select s.sa2, coalesce(x, 1) as first, coalesce(y, 2) as second, coalesce(z, 5) as third from (select distinct sa2 from cells) s left join e3 using (sa2)
""", (123,))
def quartile_breaks(t):
    """Edges of classes of the destinations that cells reach in 20 minutes, for each suburb."""
    reached = t.pairs().filter("minutes <= 20").groupBy(F.col("origin").alias("cell")).agg(F.count("*").alias("n"))
    rows = t.cells().select("sa2", "cell").join(reached, "cell", "left").withColumn("n", F.when(F.col("cell") % 3 == 0, 0).otherwise(F.coalesce("n", F.lit(0))).cast("double"))
    found = areas.quartile_breaks(rows, ["sa2"], "n", "cell")
    return found.select("sa2", *[F.col("breaks")[i].alias(c) for i, c in enumerate(("first", "second", "third"))])


@query("cells pairs", """
with best as (select cell, 5 + cell % 40 as standard, (select min(minutes) from pairs p where p.origin = c.cell and mode <> 'bike' and p.destination % 3 = 0) as minutes from cells c),
b as (select *, least(60, cast(floor(standard * 2.25 + 0.5) as int)) as top from best), e as (select *, [floor(standard * 0.5 + 0.5), floor(standard * 0.75 + 0.5), standard, least(floor(standard * 1.5 + 0.5), floor((standard + top) / 2.0 + 0.5)), top] as breaks from b)
select cell, array_to_string(list_transform(breaks, lambda x: cast(x as int)), ',') as breaks, case when minutes is not null then len(list_filter(breaks, lambda x: x < minutes))::int end as class from e
""", (121, 122))
def access_classes(t):
    """Edges of classes of minutes around each cell's standard, and its class."""
    minutes = t.pairs().filter("mode != 'bike' and destination % 3 = 0").groupBy(F.col("origin").alias("cell")).agg(F.min("minutes").alias("minutes"))
    rows = t.cells().select("cell").join(minutes, "cell", "left").withColumn("breaks", areas.access_breaks(5 + F.col("cell") % 40))
    return rows.select("cell", F.array_join(F.col("breaks").cast("array<string>"), ",").alias("breaks"), areas.class_of(F.col("minutes"), F.col("breaks")).alias("class"))


@query("cells", """
with c as (select *, council || '-' || (case when cell % 200 = 0 then 1 else 0 end) as ward, greatest(population, 0) as p from cells), total as (select sum(p) as t from c),
council as (select council as n, sum(p) as people from c group by 1), ward as (select ward as n, sum(p) as people from c group by 1), own as (select sa2, sum(p) as people from c group by 1),
w1 as (select sa2, min(struct_pack(w := -w, n)).n as n from (select sa2, council as n, sum(p + 1e-6) as w from c group by all) group by sa2), w2 as (select sa2, min(struct_pack(w := -w, n)).n as n from (select sa2, ward as n, sum(p + 1e-6) as w from c group by all) group by sa2),
j as (select own.sa2, own.people, council.n as c_name, council.people as c_people, ward.n as w_name, ward.people as w_people, t from own join w1 using (sa2) join council on council.n = w1.n join w2 on w2.sa2 = own.sa2 join ward on ward.n = w2.n, total where own.people > 0),
a as (select *, c_people > 0 and abs(c_people - t) > 0.005 * t as c_in from j), b as (select *, case when c_in then c_people else t end as p1 from a), d as (select *, w_people > 0 and abs(w_people - p1) > 0.005 * p1 as w_in from b), e as (select *, case when w_in then w_people else p1 end as p2 from d)
select sa2 as area, array_to_string(list_filter([case when c_in then 'council:' || c_name end, case when w_in then 'ward:' || w_name end, case when abs(people - p2) > 0.005 * p2 then 'sa2:' || sa2 end], lambda x: x is not null), '>') as chain from e where c_in or w_in or abs(people - p2) > 0.005 * p2
""", (318, 319))
def chains_of_areas(t):
    """Each suburb with the areas around it, those left out that have the same people as the one above within half a percent."""
    cells = t.cells().withColumn("ward", F.concat("council", F.lit("-"), F.when(F.col("cell") % 200 == 0, "1").otherwise("0")))
    found = areas.chain(cells, ["council", "ward", "sa2"], "sa2", "population")
    return found.select("area", F.array_join(F.transform("chain", lambda x: F.concat(x["level"], F.lit(":"), x["name"])), ">").alias("chain"))


@query("cells reach", """
with r as (select *, rank() over (partition by cell, mode order by minutes) as k from reach),
n as (select cell, mode, min(minutes) as minutes, string_agg(school, '|' order by metres, school) as schools from r where k = 1 group by all),
age as (select cell, round(greatest(0, coalesce(population * older, 0) - coalesce(population * no_car, 0)) * 0.48, 4) as girls from cells where population > 0)
select age.cell, girls, max(minutes) filter (where mode = 'walk') as walk, max(schools) filter (where mode = 'walk') as walk_schools, max(minutes) filter (where mode = 'pt') as pt, max(schools) filter (where mode = 'pt') as pt_schools, count(minutes) > 0 as routed from age left join n using (cell) group by age.cell, girls
""", (64, 145, 321))
def schools_csv(t):
    """A row for each cell with residents: girls of an age group that is the rest of two others, minutes by each mode with the numbers of all nearest schools, and whether any mode gets to one."""
    near = choices.nearest_with_ties(t.reach(), ["cell", "mode"])
    near = near.withColumn("schools", F.array_join(F.concat(F.array("school"), F.col("ties")).cast("array<string>"), "|"))
    of = lambda m, c: F.max(F.when(F.col("mode") == m, F.col(c)))
    wide = near.groupBy("cell").agg(of("walk", "minutes").alias("walk"), of("walk", "schools").alias("walk_schools"), of("pt", "minutes").alias("pt"), of("pt", "schools").alias("pt_schools"), F.lit(True).alias("routed"))
    rest = F.greatest(F.lit(0.0), F.coalesce(F.col("population") * F.col("older"), F.lit(0.0)) - F.coalesce(F.col("population") * F.col("no_car"), F.lit(0.0)))
    people = t.cells().filter("population > 0").select("cell", F.round(rest * 0.48, 4).alias("girls"))
    return people.join(wide, "cell", "left").withColumn("routed", F.coalesce("routed", F.lit(False)))


@query("cells", """
with c as (select *, greatest(population, 0) as p, council || '-' || cast(zone as varchar) as ward from cells),
size as (select n, least(sqrt(greatest(max(x) - min(x), 500) * greatest(max(y) - min(y), 500)), greatest(sqrt(count(*) * 105000.0), 500)) as size from (select 'council:' || council as n, x, y from c union all select 'ward:' || ward, x, y from c union all select 'sa2:' || sa2, x, y from c) group by n),
view as (select cell, council, ward, sa2, 300.0 * pow(2, cell % 7) * 0.4 as reach from c)
select cell, case when s.size >= reach then 'sa2:' || sa2 when w.size >= reach then 'ward:' || ward when k.size >= reach then 'council:' || council end as area
from view join size s on s.n = 'sa2:' || sa2 join size w on w.n = 'ward:' || ward join size k on k.n = 'council:' || council
""", (242, 243, 244))
def area_in_view(t):
    """The smallest of the areas around each cell that is at least 0.4 of a view across; none for the whole place."""
    cells = t.cells().withColumn("ward", F.concat("council", F.lit("-"), F.col("zone").cast("string")))
    levels, out = ["council", "ward", "sa2"], cells.select("cell", "council", "ward", "sa2", (300.0 * F.pow(F.lit(2.0), F.col("cell") % 7) * 0.4).alias("reach"))
    for level in levels:
        out = out.join(areas.sizes(cells, level, 500.0, 105_000.0).withColumnRenamed("size", f"{level}_size"), level)
    pick = F.coalesce(*[F.when(F.col(f"{level}_size") >= F.col("reach"), F.concat(F.lit(f"{level}:"), F.col(level))) for level in reversed(levels)])
    return out.select("cell", pick.alias("area"))


@query("reach schools", """
select cell, area, school, minutes, metres from (select cell, area, school, minutes, metres, row_number() over (partition by cell, area order by minutes, metres, school) as k from reach join schools using (school) where mode = 'walk') where k = 1
""", (222,))
def quickest_by_group(t):
    """Of each cell and group of schools the quickest walk, then the nearest."""
    walks = t.reach().filter("mode = 'walk'").join(t.schools().select("school", "area"), "school")
    best = walks.groupBy("cell", "area").agg(F.min(F.struct("minutes", "metres", "school")).alias("b"))
    return best.select("cell", "area", "b.school", "b.minutes", "b.metres")


@query("cells pairs", """
with n as (select origin, service, mode, count(*) filter (where minutes <= 10) as n10, count(*) filter (where minutes <= 15) as n15, count(*) filter (where minutes <= 20) as n20, count(*) filter (where minutes <= 30) as n30 from pairs group by all)
select cell, e.service, coalesce(max(n10), 0) as n10, coalesce(max(n15), 0) as n15, coalesce(max(n20), 0) as n20, coalesce(max(n30), 0) as n30
from cells cross join (select distinct service from destinations where service is not null) e left join n on n.origin = cell and n.service = e.service and n.mode in ('walk', 'pt') group by cell, e.service
""", (53,))
def choice_counts(t):
    """How many of each service are within each limit by the mode that reaches most of them, for every cell."""
    counts = measures.counts_within(t.pairs().filter("mode in ('walk', 'pt')"), [F.col("origin").alias("cell"), "service", "mode"])
    steps = [f"n{s}" for s in measures.STEPS]
    most = counts.groupBy("cell", "service").agg(*[F.max(c).alias(c) for c in steps])
    every = measures.for_every_cell(t.cells().select("cell"), t.services(), most, "service", steps)
    return every.select("cell", "service", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in steps])


@query("cells schools zone_maps", "with " + _LISTED + """, z as (select school, max(x1) as x1, min(x0) as x0, max(y1) as y1, min(y0) as y0 from zone_maps join status using (school) where status.status in ('in_force', 'upcoming_used') group by school),
hit as (select c.sa2, c.population as w, c.older, z.school from cells c join z on c.x >= x0 and c.x < x1 and c.y >= y0 and c.y < y1 where c.population > 0),
one as (select sa2, school, sum(w) as w, sum(w * older) as children from hit group by all), most as (select sa2, max(w) as most, sum(w) as total, count(*) as sets, sum(children) as children from one group by sa2), own as (select sa2, max(one.children) as c from one join most using (sa2) where w = most group by sa2)
select sa2, sets, round(total, 4) as split_people, round(total - most, 4) as outside, round(most.children, 4) as children, round(most.children - c, 4) as children_outside from most join own using (sa2) where sets > 1
""", (280,))
def split_people(t):
    """People of suburbs that several zones share, and how many of them and of an age group live outside the zone that has most of them."""
    box = shapes.with_box(t.zone_maps().select("school", "corners"), "corners").groupBy("school").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    zoned = box.join(_status(t).filter(F.col("status").isin(*zones.ZONED)).select("school"), "school", "left_semi")
    homes = t.cells().filter("population > 0").select("sa2", F.col("population").alias("w"), "older", F.col("x").alias("hx"), F.col("y").alias("hy"), *[F.col(c).alias(f"{c}{i}") for i in (0, 1) for c in "xy"])
    sides = zoned.select("school", *shapes.BOX, *[F.col(c).alias(f"_z{c}") for c in shapes.BOX])
    hit = shapes.meeting(homes, sides, 1000.0).filter("hx >= _zx0 and hx < _zx1 and hy >= _zy0 and hy < _zy1")
    one = hit.groupBy("sa2", "school").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("older")).alias("children"))
    most = one.groupBy("sa2").agg(F.max(F.struct("w", "children")).alias("m"), F.sum("w").alias("total"), F.count("*").alias("sets"), F.sum("children").alias("children")).filter("sets > 1")
    return most.select("sa2", "sets", F.round("total", 4).alias("split_people"), F.round(F.col("total") - F.col("m.w"), 4).alias("outside"), F.round("children", 4).alias("children"), F.round(F.col("children") - F.col("m.children"), 4).alias("children_outside"))
