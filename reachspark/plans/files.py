"""Queries that write results to the shared folder in the model's formats and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reachspark.operators import spatial, timetable
from reachspark.operators.common import checkpoint_folder
from reachspark.plans.registry import query
from reachspark.sources import readers, sinks
from reachspark.streaming import batches


def _folder(t) -> str:
    return f"{checkpoint_folder(t.spark)}/files-{uuid.uuid4().hex[:12]}"


@query("calls", """
select trip, stop, cast(seconds as int) as seconds, cast(null as varchar) as headsign from calls
""", (1, 2, 3))
def timetable_from_files(t):
    """Calls written as timetable text, with clocks beyond 24 h, and read again; a column that the file lacks is null."""
    path, s = _folder(t), F.col("seconds")
    clock = F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), (F.floor(s / 60) % 60).cast("int"), s % 60)
    calls = t.calls().select(F.col("trip").cast("string").alias(" trip_id"), F.concat(F.lit(" "), "stop", F.lit(" ")).alias("stop_id"), clock.alias("departure_time"), "value")
    calls.write.csv(path, header=True)
    rows = readers.timetable_file(t.spark, path, ["trip_id", "departure_time", "stop_id"], ["stop_headsign"])
    return rows.select(F.col("trip_id").cast("long").alias("trip"), F.col("stop_id").alias("stop"), timetable.seconds(F.col("departure_time")).alias("seconds"), F.col("stop_headsign").alias("headsign"))


@query("pairs", "select origin, destination, mode, minutes from pairs where mode <> 'bike'", (6, 7, 8, 9, 34))
def finished_runs(t):
    """Pairs by run; a run that the manifest doesn't have is not read, though its files are there."""
    path = _folder(t)
    pairs = t.pairs().select("origin", "destination", "mode", "minutes", F.col("mode").alias("run_tag"))
    sinks.by_partition(pairs, f"{path}/pairs", "run_tag")
    t.spark.createDataFrame([("walk",), ("pt",)], "run_tag string").write.parquet(f"{path}/manifest")
    found = [readers.finished(t.spark, f"{path}/pairs", f"{path}/manifest", tag) for tag in ("walk", "bike", "pt")]
    walk, pt = (x.drop("run_tag") for x in found if x is not None)
    return walk.unionByName(pt)


@query("destinations", """
select id, case when kind in ('ECONOMY', 'SMALL') then 'shop' else 'clinic' end as service from destinations where x between 2000 and 7000 and y between 1000 and 9000 and id % 13 <> 0 and kind in ('ECONOMY', 'SMALL', 'LARGE')
union all select id, 'clinic' from destinations where x between 2000 and 7000 and y between 1000 and 9000 and id % 13 <> 0 and kind = 'SMALL'
""", (14, 15, 16))
def services_in_box(t):
    """Places in a box by their kind, which can stand for several services; a place whose longitude is no number lies in no box."""
    text = F.when(F.col("id") % 13 == 0, "unknown").otherwise(F.col("x").cast("string"))
    rows = t.destinations().select("id", "kind", text.alias("lon"), F.col("y").cast("string").alias("lat"))
    rows = rows.filter(readers.within_box(F.col("lon"), F.col("lat"), (2000, 1000, 7000, 9000)))
    return readers.by_type(rows, {"shop": ["ECONOMY", "SMALL"], "clinic": ["SMALL", "LARGE"]}, "kind").select("id", "service")


@query("cells reach", """
select cell, string_agg(school, '|' order by school) as schools, cast(round(avg(minutes), 4) as varchar) <> '' as has_mean from reach group by cell
""", (56,))
def downloads(t):
    """A download with lists as joined text, read again."""
    path = _folder(t)
    table = t.reach().groupBy("cell").agg(F.array_sort(F.collect_list("school")).alias("schools"), F.round(F.avg("minutes"), 4).alias("mean"))
    sinks.csv(table, path)
    return t.spark.read.csv(path, header=True).select(F.col("cell").cast("long").alias("cell"), "schools", F.col("mean").isNotNull().alias("has_mean"))


@query("destinations", """
select service, cast(round(sum(weight) / nullif(count(*) filter (where id % 7 > 0), 0), 4) as double) as mean, max(case when zone = 0 then name end) as name, count(*) as places from destinations group by service
""", (66, 69, 76))
def json_entries(t):
    """An object for each service, numbers that aren't finite as null, nulls kept, read again."""
    path = _folder(t)
    mean = sinks.clean(F.sum("weight") / F.nullif(F.count_if(F.col("id") % 7 > 0), F.lit(0)))
    rows = t.destinations().groupBy("service").agg(mean.alias("mean"), F.max(F.when(F.col("zone") == 0, F.col("name"))).alias("name"), F.count("*").alias("places"), F.lit(float("nan")).alias("_nan"))
    sinks.json_objects(rows.select("service", F.col("mean").alias("mean"), "name", "places", sinks.clean(F.col("_nan")).alias("none")), path)
    return t.spark.read.schema("service string, mean double, name string, places long, none double").json(path).filter("none is null").drop("none")


@query("cells", """
select cell, cell // 100 as batch, case when (cell // 100) % 4 = 1 then 'again' else 'first' end as run from cells
""", (35, 39, 61, 374, 499))
def batches_rewritten(t):
    """Batches of cells, of which those that the manifest has under another scope are worked off again; the others' files stay."""
    path = _folder(t)
    cells = batches.assign(t.cells().select("cell"), "cell", 100)
    listed = cells.select("batch").distinct()
    batches.add(cells.withColumn("run", F.lit("first")), listed.withColumn("scope", F.when(F.col("batch") % 4 == 1, "old").otherwise("now")), path)
    again = batches.stale(listed, batches.manifest(t.spark, path), "now")
    batches.add(cells.join(again, "batch").withColumn("run", F.lit("again")), again.withColumn("scope", F.lit("now")), path)
    return batches.current(t.spark, path, "cell long, batch long, run string")


@query("cells destinations", """
with d as (select id, cell, sqrt(pow(d.x - c.x, 2) + pow(d.y - c.y, 2)) as d from destinations d, cells c where cell % 4 <> 0)
select id, min(struct_pack(k := round(d, 9), cell)).cell as cell, round(min(d), 4) as metres from d where d <= 1000 group by id
""", (227, 229))
def cell_near(t):
    """The cell of each place: the nearest populated one within a kilometre."""
    cells = t.cells().filter("cell % 4 != 0").select("cell", F.col("x").alias("tx"), F.col("y").alias("ty"))
    near = spatial.nearest(t.destinations().select("id", "x", "y"), cells, ["id"], "cell", 100.0, 1000.0)
    return near.select("id", "cell", F.round("d", 4).alias("metres"))
