"""Queries on timetables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reachspark.operators import timetable
from reachspark.plans.registry import query


@query("", """
select event_id, cast(h as varchar) || ':' || lpad(cast(m as varchar), 2, '0') || ':00' as clock, h * 3600 + m * 60 as seconds
from (select event_id, cast(event_id % 30 as int) as h, cast(minute(ts) as int) as m from events)
""", (444, 445))
def clock_seconds(t):
    e = t.raw("events").select("event_id", F.concat((F.col("event_id") % 30).cast("string"), F.lit(":"), F.lpad(F.minute("ts").cast("string"), 2, "0"), F.lit(":00")).alias("clock"))
    return e.withColumn("seconds", timetable.seconds(F.col("clock")))


_CAL = """calendar as (select cast(s_suppkey as varchar) as service, ['20240101', '20240105', '20240110'][s_suppkey % 3 + 1] as first, ['20240131', '20240112', '20240120'][s_suppkey % 3 + 1] as last, s_suppkey from supplier),
exception as (select cast(s_suppkey as varchar) as service, '20240110' as date, cast(1 + s_suppkey % 2 as int) as kind from supplier where s_suppkey % 5 = 0)"""


@query("", "with " + _CAL + """
select distinct service from (select service from calendar where (s_suppkey + 2) % 7 < 5 and first <= '20240110' and last >= '20240110' union all select service from exception where date = '20240110' and kind = 1)
where service not in (select service from exception where date = '20240110' and kind = 2)
""", (103, 104))
def active_services(t):
    return timetable.active_services(*_calendar(t), "20240110")


def _calendar(t):
    k = F.col("s_suppkey")
    of = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % 3 + 1).cast("int"))
    days = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.when((k + d) % 7 < 5, 1).otherwise(0))
    s = t.raw("supplier")
    calendar = s.select(k.cast("string").alias("service"), of("20240101", "20240105", "20240110").alias("start"), of("20240131", "20240112", "20240120").alias("end"), days.alias("weekdays"))
    exceptions = s.filter(k % 5 == 0).select(k.cast("string").alias("service"), F.lit("20240110").alias("date"), (1 + k % 2).cast("int").alias("kind"))
    return calendar, exceptions


_DAYS = _CAL + """, dated as (select service, s_suppkey, unnest(generate_series(strptime(first, '%Y%m%d'), strptime(last, '%Y%m%d'), interval 1 day))::date as day from calendar),
running as (select service, day from dated where (s_suppkey + isodow(day) - 1) % 7 < 5 and day <= date '2024-01-31' and not (day = date '2024-01-10' and service in (select service from exception where kind = 2))
  union select service, date '2024-01-10' from exception where kind = 1)"""


@query("", "with " + _DAYS + " select service, day from running", (103, 104))
def service_days(t):
    """Every day of a month on which each service runs."""
    return timetable.service_days(*_calendar(t), "20240101", "20240131")


@query("calls", "with " + _DAYS + """,
made as (select stop, route, cast(running.day + case when seconds >= 86400 then 1 else 0 end as date) as day, call % 9 <> 0 as board, call % 11 <> 0 as alight
  from (select stop, route, call, seconds, cast(trip % 40 as varchar) as service from calls) join running using (service) where seconds % 86400 >= 25200 and seconds % 86400 < 32400)
select day, stop, count(*) filter (where board) as departures, count(*) filter (where board) * cast(0.5 as double) as per_hour, count(*) filter (where alight) as set_down from made where board or alight group by day, stop
""", (162, 165))
def departures_per_hour(t):
    """Departures from each stop between 7 and 9 on each day: of services of that day, and after 24 h of those of the day before."""
    calls = t.calls().select("stop", "route", "call", "seconds", (F.col("trip") % 40).cast("string").alias("service"), F.when(F.col("call") % 9 == 0, 1).alias("pickup"), F.when(F.col("call") % 11 == 0, 1).otherwise(0).alias("drop_off"))
    made = timetable.departures(calls, timetable.service_days(*_calendar(t), "20240101", "20240131"), 25200, 32400)
    rate = timetable.per_hour(made, ["day", "stop"], 25200, 32400)
    return rate.join(made.groupBy("day", "stop").agg(F.count_if("alight").alias("set_down")), ["day", "stop"])


@query("calls", """
select grp, route, count(distinct trip) as trips, array_to_string(list_sort(list(distinct stop)), ',') as stops, bool_and(seconds < 86400) as same_day from calls group by grp, route
""", (166, 60, 143))
def stop_routes(t):
    return t.calls().groupBy("grp", "route").agg(F.count_distinct("trip").alias("trips"), F.array_join(F.array_sort(F.collect_set("stop")), ",").alias("stops"), F.bool_and(F.col("seconds") < 86400).alias("same_day"))


@query("calls", """
with trip as (select route, day, trip, list(stop order by seconds, call) as pattern, min(seconds) as start from calls where isodow(day) <= 5 group by all),
pat as (select route, pattern, count(*) as trips, count(*) filter (where start >= 25200 and start < 32400) as inside from trip group by all),
main as (select route, min(struct_pack(t := -trips, pattern)).pattern as main, max(trips) as main_trips, cast(sum(trips) as bigint) as trips, count(*) as patterns, round(cast(sum(inside) as double) * 0.5 / (select count(distinct day) from trip), 6) as per_hour from pat group by route),
first_ as (select route, stop, min(struct_pack(t := -trips, pattern, pos)) as f from (select route, trips, pattern, unnest(pattern) as stop, generate_subscripts(pattern, 1) as pos from pat) group by all),
served as (select route, string_agg(stop, ',' order by f, stop) as stops from first_ group by route)
select route, main[1] as "from", main[-1] as "to", array_to_string(main, '>') as main, main_trips, trips, patterns, per_hour, stops from main join served using (route)
""", (164, 369))
def line_patterns(t):
    """Lines by their trips on weekdays; a trip is of one service day."""
    found = timetable.lines(t.calls().filter(F.weekday("day") < 5), "day", "trip", "route", 25200, 32400)
    return found.withColumns({"per_hour": F.round("per_hour", 6), "main": F.array_join("main", ">"), "stops": F.array_join("stops", ",")})


@query("calls", """
with ride as (select b.day, b.route, b.stop as board, a.stop as alight, b.seconds as dep, (a.seconds - b.seconds) / 60.0::double as ride from calls b join calls a on a.trip = b.trip and a.day = b.day and a.call > b.call where b.seconds >= 25200 and b.seconds < 43200 + 2700)
select day, route, board, alight, count(*) filter (where dep < 43200) as trips, round(quantile_cont(ride, 0.5), 4) as median, round(min(ride), 4) as least, round(max(ride), 4) as most, case when count(*) filter (where dep < 43200) > 0 then round(300.0::double / count(*) filter (where dep < 43200), 1) end as headway
from ride group by all
""", (24,))
def ride_headway(t):
    """Of each route, day and pair of stops: trips that leave between 7 and 12, minutes between them, and how long the ride takes."""
    found = timetable.rides(t.calls(), ["day", "trip"], ["day", "route"], 25200, 43200, 2700)
    return found.withColumns({c: F.round(c, 4) for c in ("median", "least", "most")})


@query("calls", """
select b.stop as board, a.stop as alight, count(*) as rides, quantile_cont(a.seconds - b.seconds, 0.5) as median, min(a.seconds - b.seconds) as least, max(a.seconds - b.seconds) as most
from calls b join calls a on a.trip = b.trip and a.day = b.day and a.call > b.call and a.seconds > b.seconds group by all
""", (24, 165))
def rides_between_stops(t):
    c = t.calls().select("trip", "day", "call", "stop", "seconds")
    b = c.select("trip", "day", F.col("call").alias("b_call"), F.col("stop").alias("board"), F.col("seconds").alias("b"))
    rides = c.join(b, ["trip", "day"]).filter("call > b_call and seconds > b").withColumn("ride", F.col("seconds") - F.col("b"))
    return rides.groupBy("board", F.col("stop").alias("alight")).agg(F.count("*").alias("rides"), F.percentile("ride", 0.5).alias("median"), F.min("ride").alias("least"), F.max("ride").alias("most"))


@query("", """
select l_orderkey % 1200 as kind, case when l_orderkey % 1200 = 2 or l_orderkey % 1200 between 100 and 199 then 'train' when l_orderkey % 1200 = 4 or l_orderkey % 1200 between 1000 and 1099 then 'ferry'
  when l_orderkey % 1200 = 3 or l_orderkey % 1200 between 700 and 799 then 'bus' when l_orderkey % 1200 = 0 or l_orderkey % 1200 between 900 and 999 then 'tram' else 'other' end as mode, count(*) as lines from lineitem group by 1
""", (101, 144))
def route_modes(t):
    k = F.col("l_orderkey") % 1200
    return t.raw("lineitem").groupBy(k.alias("kind")).agg(F.count("*").alias("lines")).withColumn("mode", timetable.mode_word(F.col("kind")))


@query("calls", """
select stop, grp, case when stop like 'click%' then 'train' else 'ferry' end as mode, n from (select stop, grp, count(distinct trip) as n from calls group by all) where n >= 2
""", (167,))
def station_groups(t):
    s = t.calls().groupBy("stop", "grp").agg(F.count_distinct("trip").alias("n")).filter("n >= 2")
    return s.select("stop", "grp", F.when(F.col("stop").startswith("click"), "train").otherwise("ferry").alias("mode"), "n")


@query("calls", """
select trip, day, call, stop, seconds, cast(seconds - first as int) as since, cast(n as int) as number from (select *, min(seconds) over (partition by trip, day) as first, row_number() over (partition by trip, day order by seconds, call) as n from calls)
""", ())
def trip_progress(t):
    w = W.partitionBy("trip", "day")
    return t.calls().select("trip", "day", "call", "stop", "seconds", (F.col("seconds") - F.min("seconds").over(w)).cast("int").alias("since"), F.row_number().over(w.orderBy("seconds", "call")).alias("number"))


@query("", """
select event_id, (dayofweek(ts) in (0, 6)) or hour(ts) < 7 or hour(ts) >= 9 and hour(ts) < 15 or hour(ts) >= 19 as offpeak, hour(ts) as hour, isodow(ts) - 1 as weekday from events
""", (113, 461))
def offpeak(t):
    spans = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 7), (9, 15), (19, 24))])
    h, d = F.hour("ts"), F.weekday("ts")
    return t.raw("events").select("event_id", ((d >= 5) | F.exists(spans, lambda s: (h >= s["a"]) & (h < s["b"]))).alias("offpeak"), h.cast("long").alias("hour"), d.cast("long").alias("weekday"))
