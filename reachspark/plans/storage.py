"""Queries on encodings, digests and incremental work."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachspark.operators import storage
from reachspark.operators.common import running
from reachspark.plans.registry import query
from reachspark.streaming import batches


def _joined(df, *columns):
    return df.select(*[F.array_join(c, ",").alias(c) if c in columns else c for c in df.columns])


@query("reach", """
with c as (select mode, cell, count(*) as n, array_to_string(list(school order by minutes, metres, school), ',') as school, array_to_string(list(minutes order by minutes, metres, school), ',') as minutes from reach group by mode, cell)
select mode, cell, cast(coalesce(sum(n) over (partition by mode order by cell rows between unbounded preceding and 1 preceding), 0) as bigint) as offset, n, school, minutes from c
""", (42, 43, 71, 456, 184, 376))
def csr_encode(t):
    return _joined(storage.csr(t.reach(), ["mode"], "cell", ["minutes", "metres", "school"], ["school", "minutes"]), "school", "minutes")


@query("cells", "select sa2, row_number() over (order by sa2) - 1 as code from (select distinct sa2 from cells)", (46, 65, 49))
def dictionary_codes(t):
    return storage.dictionary(t.cells(), "sa2").withColumn("code", F.col("code").cast("long"))


@query("destinations", """
select service, sha256(string_agg(d, '' order by part)) as digest, cast(sum(n) as bigint) as members from (
  select service, substr(m, 1, 3) as part, sha256(string_agg(m, '' order by m)) as d, count(*) as n from (select service, md5(cast(id as varchar) || '|' || service || '|' || cast(zone as varchar)) as m from destinations) group by all) group by service
""", (379, 380))
def members_digest(t):
    return storage.members_digest(t.destinations(), ["service"], ["id", "service", "zone"])


_TWO = """a as (select origin, destination, min(minutes) as before from pairs where mode <> 'walk' group by all), b as (select origin, destination, min(minutes) as after from pairs where mode <> 'pt' group by all)"""


@query("pairs", "with " + _TWO + """
select coalesce(a.origin, b.origin) as origin, coalesce(a.destination, b.destination) as destination, before, after, case when before is null then 'added' when after is null then 'removed' else 'changed' end as change
from a full join b on a.origin = b.origin and a.destination = b.destination where before is distinct from after
""", (168, 170, 171))
def build_diff(t):
    best = lambda skip: t.pairs().filter(F.col("mode") != skip).groupBy("origin", "destination").agg(F.min("minutes").alias("minutes"))
    return storage.build_diff(best("walk"), best("pt"), ["origin", "destination"], "minutes")


@query("reach", """
with fresh as (select cell, school, mode, minutes + 1 as minutes from reach where school % 10 = 3)
select cell, school, mode, minutes from reach where school not in (select school from fresh) union all select * from fresh
""", (489, 490, 491, 492))
def incremental_merge(t):
    r = t.reach().select("cell", "school", "mode", "minutes")
    fresh = r.filter("school % 10 = 3").withColumn("minutes", F.col("minutes") + 1)
    return storage.incremental_merge(r, fresh, fresh, "school")


@query("destinations", """
with prev as (select name, min(id) as id from destinations where id % 3 = 0 group by name), n as (select distinct name from destinations)
select n.name, cast(coalesce(prev.id, (select max(id) from prev) + row_number() over (partition by prev.id is null order by n.name)) as bigint) as id from n left join prev using (name)
""", (178, 176, 180))
def stable_ids(t):
    d = t.destinations()
    previous = d.filter("id % 3 = 0").groupBy("name").agg(F.min("id").alias("id"))
    return storage.stable_ids(d, previous, "name")


@query("pairs destinations", """
with a as (select origin, sum(weight) as s from pairs join destinations on destination = id where mode = 'pt' group by origin), b as (select origin, sum(case when minutes <= 40 then weight else 0 end) as s from pairs join destinations on destination = id where mode = 'pt' group by origin)
select origin, a.s as run, b.s as recount from a join b using (origin) where abs(a.s - b.s) > 0.01 + 1e-5 * abs(b.s)
""", (155, 154, 493))
def check_jobs(t):
    rows = t.pairs().filter("mode = 'pt'").join(t.destinations().select(F.col("id").alias("destination"), "weight"), "destination")
    s = rows.groupBy("origin").agg(F.sum("weight").alias("run"), F.sum(F.when(F.col("minutes") <= 40, F.col("weight")).otherwise(0.0)).alias("recount"))
    return s.filter(~storage.tolerance(F.col("run"), F.col("recount"), 0.01, 1e-5))


@query("pairs", """
select mode, origin // 64 as tile, origin, destination, minutes, row_number() over (partition by mode, origin // 64 order by origin, destination) as place, count(*) over (partition by mode, origin) as of_origin from pairs
""", (45, 188, 375))
def tile_rows(t):
    """Rows of tiles of 64 origins; tiles grow in number with the origins, not in size."""
    p = t.pairs().select("mode", F.floor(F.col("origin") / 64).cast("long").alias("tile"), "origin", "destination", "minutes")
    return storage.tile_rows(p, ["mode", "tile"], "origin", "destination").withColumn("place", F.col("place").cast("long"))


@query("cells", """
with b as (select cell // 100 as batch, count(*) as cells from cells group by 1) select batch, cells from b where batch % 3 = 1 and not (batch % 2 = 0 and batch % 4 <> 2)
""", (38, 375, 486, 487, 488))
def stale_batches(t):
    b = batches.assign(t.cells().select("cell"), "cell", 100).groupBy("batch").agg(F.count("*").alias("cells"))
    manifest = b.filter("batch % 2 = 0").select("batch", F.when(F.col("batch") % 4 == 2, "old").otherwise("now").alias("scope"))
    return batches.shard(batches.stale(b, manifest, "now"), 1, 3)


@query("pairs", """
select origin, max(case when mode = 'walk' then minutes end) as t_walk, max(case when mode = 'pt' then minutes end) as t_pt, cast(round(avg(minutes), 1) as double) as mean, count(*) as n from pairs group by origin
""", (179,))
def cell_payload(t):
    of = lambda m: F.max(F.when(F.col("mode") == m, F.col("minutes")))
    return t.pairs().groupBy("origin").agg(of("walk").alias("t_walk"), of("pt").alias("t_pt"), F.round(F.avg("minutes"), 1).alias("mean"), F.count("*").alias("n"))


@query("", "select o_orderkey as node, cast(sum(1 + o_custkey % 5) over (partition by o_orderkey % 8 order by o_orderkey rows unbounded preceding) as bigint) as x from orders", (400,))
def delta_decode(t):
    rows = t.raw("orders").select(F.col("o_orderkey").alias("node"), (F.col("o_orderkey") % 8).alias("tile"), (1 + F.col("o_custkey") % 5).alias("step"))
    return running(rows, ["tile"], ["node"], "step").select("node", F.col("_upto").alias("x"))


@query("destinations", "select kind, service, count(*) as n, sum(weight) as weight, min(id) as first from destinations group by all having count(*) >= 2", ())
def destination_sets(t):
    return t.destinations().groupBy("kind", "service").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.min("id").alias("first")).filter("n >= 2")


@query("schools cells", "select s_suppkey as school from supplier where s_suppkey not in (select school from schools where kind = 'state')", (99, 382))
def anti_members(t):
    return t.schools().select("school").join(t.schools().filter("kind = 'state'").select("school"), "school", "left_anti")


@query("pairs", """
select destination, origin, mode, minutes, count(*) over (partition by destination, mode) - count(*) over (partition by destination, mode order by minutes range unbounded preceding) as behind from pairs
""", (161, 169))
def slower_origins(t):
    """How many origins reach each pair's destination by its mode in more minutes."""
    return storage.slower(t.pairs().select("destination", "origin", "mode", "minutes"), ["destination", "mode"], "minutes", "behind")


@query("cells", """
select cell, population, older, case when urban then population else 0 end as urban_people, round(population * case when zone = 0 then 1.0 when zone = 1 then 0.5 else 0.0 end, 6) as zone_people from cells
""", (185, 281, 475, 483))
def masked_people(t):
    part = F.when(F.col("zone") == 0, 1.0).when(F.col("zone") == 1, 0.5).otherwise(0.0)
    return t.cells().select("cell", "population", "older", F.when(F.col("urban"), F.col("population")).otherwise(0.0).alias("urban_people"), F.round(F.col("population") * part, 6).alias("zone_people"))


@query("pairs_w", """
with w as (select origin, service, min(minutes) filter (where win = 'saturday') as asked, min(minutes) filter (where win = 'usual') as usual from pairs_w where mode = 'pt' group by all)
select origin, service, coalesce(asked, usual) as minutes, case when asked is not null then 'saturday' else 'usual' end as win from w
""", (135, 433, 462))
def window_fallback(t):
    of = lambda w: F.min(F.when(F.col("win") == w, F.col("minutes")))
    w = t.pairs(windows=True).filter("mode = 'pt'").groupBy("origin", "service").agg(of("saturday").alias("asked"), of("usual").alias("usual"))
    return w.select("origin", "service", F.coalesce("asked", "usual").alias("minutes"), F.when(F.col("asked").isNotNull(), "saturday").otherwise("usual").alias("win"))


@query("pairs", """
with r as (select origin, destination, mode, minutes, count(*) as n from trips group by all)
select origin, destination, mode, minutes, n from (select *, row_number() over (partition by origin, destination order by n desc, minutes, mode) as k from r) where k = 1
""", (368,))
def most_used(t):
    from pyspark.sql import Window as W

    r = t.trips().groupBy("origin", "destination", "mode", "minutes").agg(F.count("*").alias("n"))
    order = W.partitionBy("origin", "destination").orderBy(F.desc("n"), "minutes", "mode")
    return r.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


@query("reach", """
select cell, mode, school, minutes, metres, minutes > 15 as far from (select *, row_number() over (partition by cell, mode order by minutes, metres, school) as k from reach where minutes <= 30) where k <= 3
""", (120, 221, 223, 373))
def nearest_stations(t):
    from pyspark.sql import Window as W

    order = W.partitionBy("cell", "mode").orderBy("minutes", "metres", "school")
    return t.reach().filter("minutes <= 30").withColumn("_k", F.row_number().over(order)).filter("_k <= 3").select("cell", "mode", "school", "minutes", "metres", (F.col("minutes") > 15).alias("far"))


@query("calls", """
with o as (select stop, value, seconds, abs(value - 10) + abs(seconds - 40000) / 1000.0 as off from calls)
select stop, cast(count(*) as bigint) as n, min(round(cast(off as double), 6)) as off from o group by stop
""", ())
def best_shape(t):
    off = F.abs(F.col("value") - 10) + F.abs(F.col("seconds") - 40000) / 1000.0
    return t.calls().groupBy("stop").agg(F.count("*").alias("n"), F.min(F.round(off, 6)).alias("off"))


@query("cells pairs", """
with m as (select origin, min(minutes) filter (where mode = 'walk') as walk, min(minutes) filter (where mode = 'pt') as ride from pairs group by origin)
select cell, case when walk is null and ride is null then 'none' when walk is not null and (ride is null or walk <= ride) then 'foot' else 'ride' end as words, walk, ride, walk is not null and ride is not null and walk <= ride as really_a_walk from cells left join m on origin = cell
""", (138, 139))
def trip_words(t):
    of = lambda m: F.min(F.when(F.col("mode") == m, F.col("minutes")))
    m = t.pairs().groupBy(F.col("origin").alias("cell")).agg(of("walk").alias("walk"), of("pt").alias("ride"))
    foot = F.col("walk").isNotNull() & (F.col("ride").isNull() | (F.col("walk") <= F.col("ride")))
    words = F.when(F.col("walk").isNull() & F.col("ride").isNull(), "none").when(foot, "foot").otherwise("ride")
    really = F.col("walk").isNotNull() & F.col("ride").isNotNull() & F.coalesce(F.col("walk") <= F.col("ride"), F.lit(False))
    return t.cells().select("cell").join(m, "cell", "left").select("cell", words.alias("words"), "walk", "ride", really.alias("really_a_walk"))
