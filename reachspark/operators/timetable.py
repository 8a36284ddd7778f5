"""Timetables: service days, departures, lines, headways. Times are seconds that may pass 24 h."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400


def seconds(clock: Column) -> Column:
    """HH:MM:SS, hours beyond 23 included, as seconds; null where malformed."""
    p = F.split(F.trim(clock), ":")
    part = lambda i: F.try_element_at(p, F.lit(i)).try_cast("int")
    return F.when(F.size(p) == 3, part(1) * 3600 + part(2) * 60 + part(3))


def active_services(calendar: DataFrame, exceptions: DataFrame, day: str) -> DataFrame:
    """Services that run on a date (text YYYYMMDD): weekday and range, plus additions (1), minus removals (2)."""
    date = F.to_date(F.lit(day), "yyyyMMdd")
    runs = calendar.filter((F.element_at("weekdays", (F.weekday(date) + 1).cast("int")) == 1) & (F.col("start") <= day) & (F.col("end") >= day)).select("service")
    added = exceptions.filter((F.col("date") == day) & (F.col("kind") == 1)).select("service")
    removed = exceptions.filter((F.col("date") == day) & (F.col("kind") == 2)).select("service")
    return runs.unionByName(added).distinct().join(removed, "service", "left_anti")


def service_days(calendar: DataFrame, exceptions: DataFrame, first: str, last: str) -> DataFrame:
    """(service, day) of every day on which a service runs between two dates (texts YYYYMMDD), by the rules of ``active_services``."""
    as_date = lambda c: F.to_date(c, "yyyyMMdd")
    low, high = F.greatest(as_date(F.col("start")), as_date(F.lit(first))), F.least(as_date(F.col("end")), as_date(F.lit(last)))
    days = calendar.filter(low <= high).select("service", "weekdays", F.explode(F.sequence(low, high)).alias("day"))
    runs = days.filter(F.element_at("weekdays", (F.weekday("day") + 1).cast("int")) == 1).select("service", "day")
    said = exceptions.filter(F.col("date").between(first, last)).select("service", as_date(F.col("date")).alias("day"), "kind")
    return runs.unionByName(said.filter("kind = 1").drop("kind")).distinct().join(said.filter("kind = 2").drop("kind"), ["service", "day"], "left_anti")


def departures(calls: DataFrame, running: DataFrame, start: int, end: int) -> DataFrame:
    """Calls (with a service, seconds, pickup and drop_off) on the ``day`` on which they are made in [start, end) seconds: a service's own day, or the next one for a call after 24 h.

    ``board`` and ``alight`` say whether people may (types other than 1); calls at which
    neither is allowed are left out.
    """
    at = F.col("seconds")
    after = F.when((at >= start) & (at < end), 0).when((at >= start + DAY) & (at < end + DAY), 1)
    made = calls.withColumn("_after", after).filter("_after is not null").join(running.withColumnRenamed("day", "_day"), "service")
    may = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "1"
    return made.select(*calls.columns, F.date_add("_day", F.col("_after")).alias("day"), may("pickup").alias("board"), may("drop_off").alias("alight")).filter("board or alight")


def per_hour(departures: DataFrame, by: list[str], start: int, end: int) -> DataFrame:
    """(by, departures, per_hour): departures at which people may board, as a rate; a stop where they may not has 0."""
    return departures.groupBy(*by).agg(F.count_if("board").alias("departures")).withColumn("per_hour", F.col("departures") * 3600.0 / (end - start))


def lines(calls: DataFrame, day: str, trip: str, line: str, start: int, end: int) -> DataFrame:
    """A row for each line: its main pattern of stops and ends, all stops it serves, and trips an hour that start in [start, end) on one of the days that ``calls`` has.

    A trip is a ``trip`` of a service ``day``, and calls in the order of seconds, then
    ``call``. Patterns are ranked by their trips, ties in order; stops are listed as the
    patterns bring them, the most common pattern first. Lists are as long as a trip's calls
    or a line's stops.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seconds", "call", "stop")))
    days = calls.agg(F.count_distinct(day).alias("_days"))  # one row
    trips = calls.groupBy(line, day, trip).agg(ordered.alias("_c")).select(line, F.transform("_c", lambda x: x["stop"]).alias("pattern"), F.col("_c")[0]["seconds"].alias("_start"))
    inside = (F.col("_start") >= start) & (F.col("_start") < end)
    counted = trips.groupBy(line, "pattern").agg(F.count("*").alias("trips"), F.count_if(inside).alias("_in"))
    order = F.struct((-F.col("trips")).alias("t"), F.col("pattern"))
    main = counted.groupBy(line).agg(F.min_by("pattern", order).alias("main"), F.sum("trips").alias("trips"), F.max("trips").alias("main_trips"), F.count("*").alias("patterns"), (F.sum("_in") * 3600.0 / (end - start)).alias("per_hour"))
    first = counted.select(line, "trips", "pattern", F.posexplode("pattern").alias("_pos", "stop")).groupBy(line, "stop").agg(F.min(F.struct((-F.col("trips")).alias("t"), "pattern", "_pos")).alias("_first"))
    served = first.groupBy(line).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "stop"))), lambda x: x["stop"]).alias("stops"))
    main = main.join(F.broadcast(days)).withColumn("per_hour", F.col("per_hour") / F.col("_days"))
    return main.join(served, line).select(line, F.col("main")[0].alias("from"), F.element_at("main", -1).alias("to"), "main", "main_trips", "trips", "patterns", "per_hour", "stops")


def rides(calls: DataFrame, trip: list[str], by: list[str], start: int, end: int, late: int) -> DataFrame:
    """(by, board, alight): trips that leave ``board`` in [start, end), minutes between them, and median, least and greatest ride of those that leave up to ``late`` seconds after.

    Both calls are of one ``trip``, its service day included, the later one after the other
    in ``call``. Without a trip in the window there are no minutes between trips.
    """
    b = calls.select(*trip, *by, F.col("call").alias("_b"), F.col("stop").alias("board"), F.col("seconds").alias("_dep"))
    a = calls.select(*trip, F.col("call").alias("_a"), F.col("stop").alias("alight"), F.col("seconds").alias("_arr"))
    both = b.filter((F.col("_dep") >= start) & (F.col("_dep") < end + late)).join(a, trip).filter("_a > _b").withColumn("_ride", (F.col("_arr") - F.col("_dep")) / 60.0)
    out = both.groupBy(*by, "board", "alight").agg(F.count_if(F.col("_dep") < end).alias("trips"), F.percentile("_ride", 0.5).alias("median"), F.min("_ride").alias("least"), F.max("_ride").alias("most"))
    return out.withColumn("headway", F.when(F.col("trips") > 0, F.round((end - start) / 60.0 / F.col("trips"), 1)))


def mode_word(kind: Column) -> Column:
    """Basic and extended route types as a word."""
    return (
        F.when((kind == 2) | kind.between(100, 199), "train").when((kind == 4) | kind.between(1000, 1099), "ferry").when((kind == 3) | kind.between(700, 799), "bus").when((kind == 0) | kind.between(900, 999), "tram").otherwise("other")
    )
