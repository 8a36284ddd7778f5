"""The model's tables as views of the given tables, and the same views as SQL.

Each view is a lazy DataFrame; column pruning and filters reach the Parquet scans. Every
view has its statement in ``SQL`` under the same name, so that a query and its SQL read
the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachspark.operators.common import dealt

#: Services are columns of a report; a longer list is a mistake and not worked off.
MOST_SERVICES = 1000


class Tables:
    """Views over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def cells(self) -> DataFrame:
        """A row for each populated cell: the spine that measures hang on."""
        k = F.col("c_custkey")
        nation = F.broadcast(self.raw("nation"))  # fixed: 25 rows at any scale
        region = F.broadcast(self.raw("region"))  # fixed: 5 rows
        rows = self.raw("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        nzdep = (1 + k % 10).cast("int")
        return rows.select(
            k.alias("cell"), F.greatest("c_acctbal", F.lit(0.0)).alias("population"), nzdep.alias("nzdep"), F.expr("cast((2 + c_custkey % 10) div 2 as int)").alias("quintile"),
            F.col("n_name").alias("sa2"), F.col("r_name").alias("council"), F.col("c_mktsegment").alias("segment"), (F.col("c_nationkey") % 5).cast("int").alias("zone"),
            ((k * 7919) % 10000).cast("double").alias("x"), ((k * 104729) % 10000).cast("double").alias("y"), (k % 4 != 0).alias("urban"),
            ((k % 7).cast("double") / 10).alias("older"), ((k % 5).cast("double") / 10).alias("no_car"), (20000 + (k * 37) % 80000).cast("double").alias("income"), (k % 6).cast("double").alias("household"),
        )

    def destinations(self) -> DataFrame:
        """Services with a weight and a place; ``service`` is the brand, ``kind`` the type."""
        k = F.col("p_partkey")
        return self.raw("part").select(
            k.alias("id"), F.col("p_brand").alias("service"), F.col("p_type").alias("kind"), F.col("p_size").cast("double").alias("weight"), (k % 5).cast("int").alias("zone"),
            ((k * 7919) % 10000).cast("double").alias("x"), ((k * 104729) % 10000).cast("double").alias("y"), F.col("p_name").alias("name"),
        )

    def services(self) -> list[str]:
        """Names of the services that exist, in order: a list of settings, never of places or people."""
        names = [r.service for r in self.destinations().select("service").filter("service is not null").distinct().limit(MOST_SERVICES + 1).collect()]
        if len(names) > MOST_SERVICES:
            raise ValueError(f"more than {MOST_SERVICES} services")
        return sorted(names)

    def trips(self) -> DataFrame:
        """Minutes by origin, destination, mode and window; several rows for a pair."""
        items = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
        rows = items.join(self.raw("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        mode = F.when(F.col("l_returnflag") == "A", "walk").when(F.col("l_returnflag") == "N", "bike").otherwise("pt")
        return rows.select(F.col("o_custkey").alias("origin"), F.col("l_partkey").alias("destination"), mode.alias("mode"), F.when(F.col("l_linestatus") == "F", "usual").otherwise("saturday").alias("win"), F.col("l_quantity").cast("int").alias("minutes"))

    def pairs(self, windows: bool = False) -> DataFrame:
        """(origin, destination, service, mode[, win], minutes), the least minutes of each pair."""
        keys = ["origin", "destination", "mode", *(["win"] if windows else [])]
        least = self.trips().groupBy(*keys).agg(F.min("minutes").alias("minutes"))
        services = self.destinations().select(F.col("id").alias("destination"), "service")
        return least.join(services, "destination").select("origin", "destination", "service", *keys[2:], "minutes")

    def schools(self) -> DataFrame:
        """Schools with kind, sex, years and a zone scheme."""
        k = F.col("s_suppkey")
        pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))
        return self.raw("supplier").select(
            k.alias("school"), F.col("s_name").alias("name"), pick("state", "state", "integrated", "private").alias("kind"), pick("co-ed", "girls", "boys").alias("sex"),
            F.when(k % 7 == 0, None).otherwise((1 + k % 9).cast("int")).alias("years_from"), F.when(k % 7 == 0, None).otherwise((5 + k % 9).cast("int")).alias("years_to"),
            F.when(k % 11 == 0, "maori").otherwise("english").alias("medium"), (k % 3 == 0).alias("zoned"), F.col("s_nationkey").cast("int").alias("area"),
            ((k * 7919) % 10000).cast("double").alias("x"), ((k * 104729) % 10000).cast("double").alias("y"),
        )

    def reach(self, size: int | None = None) -> DataFrame:
        """(cell, school, mode, minutes, metres): who reaches which school.

        With ``size`` also tile, that many cells; rows are dealt out by it (their number is
        counted, in the files' footers) before the least minutes are taken, so that what is
        grouped by tile afterwards moves no more.
        """
        items = self.raw("lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag").join(self.raw("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        mode = F.when(F.col("l_returnflag") == "A", "walk").when(F.col("l_returnflag") == "N", "bike").otherwise("pt")
        rows, keys = items.select(F.col("o_custkey").alias("cell"), F.col("l_suppkey").alias("school"), mode.alias("mode"), F.col("l_quantity").cast("int").alias("minutes")), ["cell", "school", "mode"]
        if size:
            rows, keys = dealt(rows.withColumn("tile", F.floor(F.col("cell") / size).cast("long")), ["tile"], self.raw("lineitem").count()), [*keys, "tile"]
        least = rows.groupBy(*keys).agg(F.min("minutes").alias("minutes"))
        return least.withColumn("metres", (F.col("cell") * 31 + F.col("school") * 17) % 3000)

    def calls(self) -> DataFrame:
        """A timetable: stop, trip, route, sequence and seconds of the day (a sixth past 24 h) on a date."""
        seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts").cast("int") + F.when(F.col("event_id") % 6 == 0, 86400).otherwise(0)
        return self.raw("events").select(
            F.col("event_id").alias("call"), F.concat(F.col("event_type"), F.lit("-"), F.col("user_id") % 7).alias("stop"), F.col("event_type").alias("grp"), F.col("user_id").alias("trip"),
            (F.col("user_id") % 12).cast("int").alias("route"), F.to_date("ts").alias("day"), seconds.cast("int").alias("seconds"), F.col("value").alias("value"),
        )

    def hexagons(self) -> DataFrame:
        """Cells as polygons, 100 metres from the centre to a corner."""
        around = [(100.0, 0.0), (50.0, 86.6), (-50.0, 86.6), (-100.0, 0.0), (-50.0, -86.6), (50.0, -86.6)]
        corners = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in around])
        return self.cells().select("cell", "population", "zone", "x", "y", corners.alias("corners"))

    def blocks(self) -> DataFrame:
        """Disjoint squares of 400 metres with people; each holds a destination."""
        square = self.destinations().select(F.floor(F.col("x") / 400).cast("long").alias("bx"), F.floor(F.col("y") / 400).cast("long").alias("by"), "weight", "zone")
        squares = square.groupBy("bx", "by").agg(F.sum("weight").alias("people"), F.min("zone").alias("zone"))
        x, y = F.col("bx") * 400.0, F.col("by") * 400.0
        return squares.select((F.col("bx") * 100 + F.col("by")).alias("block"), "people", "zone", rectangle(x, y, x + 400.0, y + 400.0).alias("corners"))

    def zone_maps(self) -> DataFrame:
        """Zones of schools as they were drawn: a polygon, the day it comes into force (null: not known), and its corners."""
        k = F.col("l_suppkey")
        polygon = F.col("l_orderkey") * 1000000 + F.col("l_partkey")
        x, y = ((k * 7919) % 10000).cast("double"), ((k * 104729) % 10000).cast("double")
        hx, hy = 150.0 + polygon % 700, 150.0 + F.floor(polygon / 7).cast("long") % 600
        day = F.when(F.col("l_quantity") != 50, F.to_date("l_shipdate"))
        return self.raw("lineitem").filter("l_linenumber = 1").select(k.alias("school"), polygon.alias("polygon"), day.alias("day"), rectangle(x - hx, y - hy, x + hx, y + hy).alias("corners"))

    def ways(self) -> DataFrame:
        """Drawn lines: four shapes of each, six points a shape."""
        k = F.col("p_partkey")
        line = F.floor(k / 4).cast("long")
        bx, by, v = (line * 7919) % 10000, (line * 104729) % 10000, k % 4
        points = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: F.struct((bx + 80 * j + (k * j) % 30 + 15 * v).cast("double").alias("x"), (by + (k * 7 * j) % 60 + 25 * v).cast("double").alias("y")))
        return self.raw("part").select(k.alias("shape"), line.alias("line"), points.alias("corners"))

    def rides(self) -> DataFrame:
        """Rides on a line from a place a to a place b."""
        k = F.col("l_orderkey")
        rows = self.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.floor(F.min("l_partkey") / 4).cast("long").alias("line"))
        bx, by = (F.col("line") * 7919) % 10000, (F.col("line") * 104729) % 10000
        place = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
        return rows.select(k.alias("trip"), F.col("l_linenumber").alias("leg"), "line", place(bx - 20 + k % 220, by + k % 145).alias("a"), place(bx + 180 + 35 * F.col("l_linenumber"), by + (k * 3) % 190).alias("b"))


def rectangle(x0, y0, x1, y1):
    """Corners of a rectangle, counter-clockwise."""
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


#: Statements of the views, as the text of common table expressions.
SQL = {
    "cells": """cells as (
  select c_custkey as cell, greatest(c_acctbal, 0.0) as population, cast(1 + c_custkey % 10 as int) as nzdep, cast((2 + c_custkey % 10) // 2 as int) as quintile, n_name as sa2, r_name as council,
    c_mktsegment as segment, cast(c_nationkey % 5 as int) as zone, cast((c_custkey * 7919) % 10000 as double) as x, cast((c_custkey * 104729) % 10000 as double) as y, c_custkey % 4 <> 0 as urban,
    cast(c_custkey % 7 as double) / 10 as older, cast(c_custkey % 5 as double) / 10 as no_car, cast(20000 + (c_custkey * 37) % 80000 as double) as income, cast(c_custkey % 6 as double) as household
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)""",
    "destinations": """destinations as (
  select p_partkey as id, p_brand as service, p_type as kind, cast(p_size as double) as weight, cast(p_partkey % 5 as int) as zone, cast((p_partkey * 7919) % 10000 as double) as x,
    cast((p_partkey * 104729) % 10000 as double) as y, p_name as name from part)""",
    "trips": """trips as (
  select o_custkey as origin, l_partkey as destination, case l_returnflag when 'A' then 'walk' when 'N' then 'bike' else 'pt' end as mode,
    case l_linestatus when 'F' then 'usual' else 'saturday' end as win, cast(l_quantity as int) as minutes from lineitem join orders on l_orderkey = o_orderkey)""",
    "pairs": """pairs as (
  select origin, destination, service, mode, min(minutes) as minutes from trips join destinations on destination = id group by origin, destination, service, mode)""",
    "pairs_w": """pairs_w as (
  select origin, destination, service, mode, win, min(minutes) as minutes from trips join destinations on destination = id group by origin, destination, service, mode, win)""",
    "schools": """schools as (
  select s_suppkey as school, s_name as name, ['state', 'state', 'integrated', 'private'][s_suppkey % 4 + 1] as kind, ['co-ed', 'girls', 'boys'][s_suppkey % 3 + 1] as sex,
    case when s_suppkey % 7 <> 0 then cast(1 + s_suppkey % 9 as int) end as years_from, case when s_suppkey % 7 <> 0 then cast(5 + s_suppkey % 9 as int) end as years_to,
    case when s_suppkey % 11 = 0 then 'maori' else 'english' end as medium, s_suppkey % 3 = 0 as zoned, cast(s_nationkey as int) as area,
    cast((s_suppkey * 7919) % 10000 as double) as x, cast((s_suppkey * 104729) % 10000 as double) as y from supplier)""",
    "reach": """reach as (
  select *, (cell * 31 + school * 17) % 3000 as metres from (
    select o_custkey as cell, l_suppkey as school, case l_returnflag when 'A' then 'walk' when 'N' then 'bike' else 'pt' end as mode, min(cast(l_quantity as int)) as minutes
    from lineitem join orders on l_orderkey = o_orderkey group by all))""",
    "calls": """calls as (
  select event_id as call, event_type || '-' || cast(user_id % 7 as varchar) as stop, event_type as grp, user_id as trip, cast(user_id % 12 as int) as route, cast(ts as date) as day,
    cast(hour(ts) * 3600 + minute(ts) * 60 + second(ts) + case when event_id % 6 = 0 then 86400 else 0 end as int) as seconds, value from events)""",
    "hexagons": """hexagons as (
  select cell, population, zone, x, y, [{'x': x + 100, 'y': y}, {'x': x + 50, 'y': y + 86.6}, {'x': x - 50, 'y': y + 86.6}, {'x': x - 100, 'y': y}, {'x': x - 50, 'y': y - 86.6}, {'x': x + 50, 'y': y - 86.6}] as corners from cells)""",
    "blocks": """blocks as (
  select gx * 100 + gy as block, people, zone, gx * 400.0 as x0, gy * 400.0 as y0, gx * 400.0 + 400 as x1, gy * 400.0 + 400 as y1
  from (select cast(floor(x / 400) as bigint) as gx, cast(floor(y / 400) as bigint) as gy, sum(weight) as people, min(zone) as zone from destinations group by all))""",
    "zone_maps": """zone_maps as (
  select school, polygon, day, cast(x - (150 + polygon % 700) as double) as x0, cast(y - (150 + (polygon // 7) % 600) as double) as y0, cast(x + (150 + polygon % 700) as double) as x1, cast(y + (150 + (polygon // 7) % 600) as double) as y1
  from (select l_suppkey as school, l_orderkey * 1000000 + l_partkey as polygon, case when l_quantity <> 50 then cast(l_shipdate as date) end as day, (l_suppkey * 7919) % 10000 as x, (l_suppkey * 104729) % 10000 as y from lineitem where l_linenumber = 1))""",
    "ways": """ways as (
  select p_partkey as shape, p_partkey // 4 as line, list_transform(range(6), lambda j: {'x': cast(((p_partkey // 4) * 7919) % 10000 + 80 * j + (p_partkey * j) % 30 + 15 * (p_partkey % 4) as double), 'y': cast(((p_partkey // 4) * 104729) % 10000 + (p_partkey * 7 * j) % 60 + 25 * (p_partkey % 4) as double)}) as corners from part)""",
    "rides": """rides as (
  select l_orderkey as trip, l_linenumber as leg, line, cast((line * 7919) % 10000 - 20 + l_orderkey % 220 as double) as ux, cast((line * 104729) % 10000 + l_orderkey % 145 as double) as uy,
    cast((line * 7919) % 10000 + 180 + 35 * l_linenumber as double) as vx, cast((line * 104729) % 10000 + (l_orderkey * 3) % 190 as double) as vy
  from (select l_orderkey, l_linenumber, min(l_partkey) // 4 as line from lineitem group by all))""",
}

_NEEDS = {"hexagons": ("cells",), "blocks": ("destinations",), "pairs": ("trips", "destinations"), "pairs_w": ("trips", "destinations")}


def with_views(names: str, query: str, recursive: bool = False) -> str:
    """``query`` with the statements of the views it names, each once."""
    order: list[str] = []
    for name in names.split():
        for n in (*_NEEDS.get(name, ()), name):
            if n not in order:
                order.append(n)
    head = ", ".join(SQL[n] for n in order)
    body = query.strip()
    joined = "," if body[:5].lower() == "with " and head else ""
    if joined:
        body = body[5:].removeprefix("recursive ")
    return (f"with {'recursive ' if recursive else ''}{head}{joined} {body}") if head else query
