"""Queries on arrays in tiles, their decoding, and tables that are kept current."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reachspark.operators import names, payloads
from reachspark.operators.common import checkpoint_folder, checkpointed
from reachspark.plans.registry import query
from reachspark.streaming.maintained import Maintained, relabelled

#: Cells of a tile.
SIZE = 64

def _reached(t, size=None):
    """Who reaches which school, with ``size`` dealt out by tile; where it holds, r5 has the minutes by public transport alone, null if it doesn't get there."""
    r5 = F.when((F.col("cell") + F.col("school")) % 5 == 0, F.struct(F.when(F.col("school") % 2 == 0, F.col("minutes") + 3).alias("value")))
    return t.reach(size).select("mode", "cell", *(["tile"] if size else []), "school", "minutes", (F.col("minutes") - 1).alias("lo"), r5.alias("r5"))


def _tiles(t, empty=False):
    return payloads.encode(_reached(t, None if empty else SIZE), t.cells().select("cell"), ["mode"], SIZE, ["minutes", "school"], ["school", "minutes", "lo"], "r5", empty).withColumn("format", F.lit(2))


@query("reach", f"""
with entry as (select mode, cell, cell // {SIZE} as tile, school, minutes, row_number() over (partition by mode, cell // {SIZE} order by cell, minutes, school) - 1 as pos from reach),
spine as (select tile, n, mode from (select c_custkey // {SIZE} as tile, max(c_custkey) % {SIZE} + 1 as n from customer group by 1), (select distinct mode from reach))
select s.mode, s.tile, s.n::int as n, (select '0' || coalesce(string_agg(',' || c, '' order by i), '') from (select i, (select count(*) from entry e where e.mode = s.mode and e.tile = s.tile and e.cell % {SIZE} <= i) as c from (select unnest(range(0, s.n)) as i))) as o,
  coalesce((select string_agg(school, ',' order by pos) from entry e where e.mode = s.mode and e.tile = s.tile), '') as d, coalesce((select string_agg(minutes, ',' order by pos) from entry e where e.mode = s.mode and e.tile = s.tile), '') as m,
  coalesce((select string_agg(pos, ',' order by pos) from entry e where e.mode = s.mode and e.tile = s.tile and (e.cell + school) % 5 = 0), '') as k
from spine s
""", (42, 43, 44, 71))
def reach_tiles(t):
    """All of who reaches which school, as lists of the cells of each tile and mode."""
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return _tiles(t, empty=True).select("mode", "tile", "n", text("o").alias("o"), text("school").alias("d"), text("minutes").alias("m"), text("k").alias("k"))


@query("reach", """
select mode, cell, school, minutes, minutes - 1 as lo, (cell + school) % 5 = 0 as marked, case when (cell + school) % 5 = 0 and school % 2 = 0 then minutes + 3 end as r5,
  row_number() over (partition by mode, cell order by minutes, school) - 1 as place from reach
""", (456, 184, 376))
def reach_round_trip(t):
    """Every entry again from the tiles."""
    rows, _ = payloads.decode(_tiles(t), ["mode"], SIZE, ["school", "minutes", "lo"], sparse=True)
    return rows.select("mode", "cell", "school", "minutes", "lo", "marked", F.col("value").alias("r5"), F.col("place").cast("long").alias("place"))


@query("reach", f"""
with spine as (select tile, mode from (select distinct c_custkey // {SIZE} as tile from customer), (select distinct mode from reach)),
full_ as (select mode, cell // {SIZE} as tile, count(*) as entries from reach group by all)
select mode, tile, case (tile + length(mode)) % 7 when 1 then 'format' when 2 then 'more entries than values' when 3 then 'number of offsets' when 4 then 'order of offsets' when 5 then 'cover of offsets' when 6 then 'position out of range' end as problem
from spine join full_ using (mode, tile) where entries > 0 and (tile + length(mode)) % 7 <> 0
""", (456, 458))
def reach_damaged(t):
    """What is found wrong with tiles that were damaged, each in one way; one in seven is left whole."""
    way = (F.col("tile") + F.length("mode")) % 7
    n = F.size("o")
    damaged = _tiles(t).withColumns({
        "format": F.when(way == 1, 3).otherwise(F.col("format")), "minutes": F.when(way == 2, F.slice("minutes", 1, F.size("minutes") - 1)).otherwise(F.col("minutes")),
        "o": F.when(way == 3, F.concat("o", "o")).when(way == 4, F.concat(F.slice("o", 1, n - 2), F.array(F.element_at("o", -1) + 1, F.element_at("o", -1)))).when(way == 5, F.transform("o", lambda x: x + 1)).otherwise(F.col("o")),
        "k": F.when(way == 6, F.array(F.size("school"))).otherwise(F.col("k")), "v": F.when(way == 6, F.array(F.lit(1))).otherwise(F.col("v")),
    })
    _, bad = payloads.decode(damaged, ["mode"], SIZE, ["school", "minutes", "lo"], sparse=True)
    return bad


@query("reach", """
select cell, school, least(1.0, greatest(0.0, case when metres % 11 = 0 then 0.0 else metres / 2000.0 end)) as weight from reach where mode = 'walk'
""", (457, 44))
def zone_weights(t):
    """Shares of cells in zones, encoded as they came and read back between 0 and 1; what is no number is 0."""
    raw = F.when(F.col("metres") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("metres") / 2000.0)
    rows = t.reach(SIZE).filter("mode = 'walk'").select("mode", "cell", "tile", "school", raw.alias("w"))
    tiles = payloads.encode(rows, t.cells().select("cell"), ["mode"], SIZE, ["school"], ["school", "w"], empty=False).withColumns({"format": F.lit(1), "w": payloads.weights(F.col("w"))})
    back, _ = payloads.decode(tiles, ["mode"], SIZE, ["school", "w"])
    return back.select("cell", "school", F.col("w").alias("weight"))


_CELL_TABLE = """w as (select cell, population, nzdep, older * 100 as older, no_car * 100 as no_car, min(minutes) filter (where mode = 'walk') as walk, min(minutes) filter (where mode = 'pt') as pt, min(minutes) filter (where mode = 'bike' and minutes <= 2) as bike
  from cells left join pairs on cell = origin group by all),
t as (select cell, cell // 64 as tile, cell % 64 as place, grp, name, value from (
  select cell, 'first' as grp, 'pop' as name, round_even(population, 1) as value from w union all select cell, 'first', 'nzdep', nzdep from w union all select cell, 'first', 'pt', pt from w union all select cell, 'later', 'older', round_even(older, 0) from w
  union all select cell, 'later', 'no_car', round_even(no_car, 0) from w union all select cell, 'later', 'walk', walk from w union all select cell, 'later', 'bike', bike from w
  union all select cell, 'later', 'ptr', case when walk is not null and not coalesce(pt <= walk, false) then coalesce(pt, -1) end from w))"""
_COLUMNS = {"first": ["pop", "nzdep", "pt"], "later": ["older", "no_car", "walk", "bike", "ptr"]}


def _cell_table(t):
    """Cells with the columns that are sent: ptr are the minutes by public transport where walking is quicker, -1 where it doesn't get there."""
    of = lambda m: F.min(F.when(F.col("mode") == m, F.col("minutes")))
    times = t.pairs().groupBy(F.col("origin").alias("cell")).agg(of("walk").alias("walk"), of("pt").alias("pt"), F.min(F.when((F.col("mode") == "bike") & (F.col("minutes") <= 2), F.col("minutes"))).alias("bike"))
    ptr = F.when(F.col("walk").isNotNull() & ~F.coalesce(F.col("pt") <= F.col("walk"), F.lit(False)), F.coalesce("pt", F.lit(-1)))
    own = t.cells().select("cell", F.col("population").alias("pop"), "nzdep", (F.col("older") * 100).alias("older"), (F.col("no_car") * 100).alias("no_car"))
    rows = own.join(times, "cell", "left").withColumn("ptr", ptr)
    return rows.select("cell", *[F.col(c).cast("double").alias(c) for cs in _COLUMNS.values() for c in cs])


@query("cells pairs", "with " + _CELL_TABLE + """,
s as (select tile, max(place) + 1 as n from t group by tile), b as (select tile, grp, name, any_value(n) as n, count(value) * 4 < any_value(n) as few, count(value) as held, cast(sum(value) as double) as total, cast(sum(value * (place + 1)) as double) as placed from t join s using (tile) group by tile, grp, name)
select tile, grp, name, cast(n as int) as n, few as sparse, case when few then held else n end as length, held, round(total, 2) as total, round(placed, 2) as placed from b
""", (40, 41, 52, 74))
def cell_columns(t):
    """Arrays a column and tile, in two groups; total and placed (values times their place) tell what the arrays hold."""
    found = payloads.columns(_cell_table(t), SIZE, _COLUMNS, {"pop": 1})
    sparse = F.col("k").isNotNull()
    entries = F.when(sparse, F.zip_with("k", "v", lambda k, v: F.struct(k.alias("k"), v.alias("v")))).otherwise(F.filter(F.transform("dense", lambda v, i: F.struct(i.alias("k"), v.alias("v"))), lambda x: x["v"].isNotNull()))
    add = lambda f: F.aggregate("e", F.lit(0.0), lambda s, x: s + f(x))
    none = F.size("e") == 0
    return found.withColumn("e", entries).select("tile", "grp", "name", "n", sparse.alias("sparse"), F.coalesce(F.size("dense"), F.size("k")).cast("long").alias("length"), F.size("e").cast("long").alias("held"),
        F.when(~none, F.round(add(lambda x: x["v"]), 2)).alias("total"), F.when(~none, F.round(add(lambda x: x["v"] * (x["k"] + 1)), 2)).alias("placed"))


@query("cells pairs", "with " + _CELL_TABLE + """
select cell, max(value) filter (where name = 'pop') as pop, max(value) filter (where name = 'nzdep') as nzdep, max(value) filter (where name = 'pt') as pt, max(value) filter (where name = 'walk') as walk, max(value) filter (where name = 'bike') as bike, max(value) filter (where name = 'ptr') as ptr from t group by cell
""", (40, 41, 52))
def cell_columns_back(t):
    """The table of cells again from its arrays."""
    names_ = ["pop", "nzdep", "pt", "walk", "bike", "ptr"]
    return payloads.cells_of(payloads.columns(_cell_table(t), SIZE, _COLUMNS, {"pop": 1}), SIZE, names_)


def _maintained(t, rows, key, batches=16):
    table = Maintained(t.spark, f"{checkpoint_folder(t.spark)}/maintained-{uuid.uuid4().hex[:12]}", key, rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), batches)
    table.update(rows, rows)
    return table


@query("reach", """
with fresh as (select cell, school, mode, minutes + 1 as minutes from reach where school % 10 = 3 and cell % 3 <> 0)
select cell, school, mode, minutes from reach where school % 10 <> 3 union all select * from fresh
""", (489,))
def reroute(t):
    """All rows after the schools that changed were worked off again, in a session that found an update stopped half-way."""
    rows = t.reach().select("cell", "school", "mode", "minutes")
    table = _maintained(t, rows, "school")
    changed = rows.filter("school % 10 = 3").select("school")
    fresh = rows.filter("school % 10 = 3 and cell % 3 != 0").withColumn("minutes", F.col("minutes") + 1)
    try:  # an update that stops between data and manifest
        table.update(fresh.withColumn("minutes", F.lit(-1)), changed, crash="data")
    except RuntimeError:
        pass
    table = Maintained(t.spark, table.path, "school")
    table.update(fresh, changed)
    table.clean()
    return table.read()


@query("reach", """
with had as (select distinct school, mode from reach), gained as (select school from had where mode = 'walk' and school % 4 = 1 and school not in (select school from had where mode = 'scooter'))
select cell, school, mode, minutes from reach where not (mode = 'bike' and school % 3 = 0)
union all select cell, school, 'scooter', minutes from reach join gained using (school) where mode = 'walk'
""", (490,))
def relabel(t):
    """Rows under labels that schools gained and lost."""
    rows = t.reach().select("cell", "school", "mode", "minutes")
    schools = t.schools().select("school")
    gained = schools.filter("school % 4 = 1").select("school", F.lit("walk").alias("source"), F.lit("scooter").alias("mode"))
    lost = schools.filter("school % 3 = 0").select("school", F.lit("bike").alias("mode"))
    return checkpointed(relabelled(rows, "mode", gained, lost, "school"))


@query("destinations", """
with place as (select lower(name) || ' ' || cast(id % 9 as varchar) as name, x, y from destinations where id % 5 <> 0), label as (select id, case when id % 4 = 0 then name else name || ' ' || cast(id % 11 as varchar) end as label from destinations),
hit as (select l.id, l.label, p.x, p.y, lower(l.label) = p.name as whole from label l join place p on p.name = lower(l.label) or starts_with(p.name, lower(l.label) || ' ')),
best as (select id, label, bool_or(whole) as exact from hit group by all)
select h.id, h.label, round(avg(x), 4) as px, round(avg(y), 4) as py, count(*) as places from hit h join best b using (id) where h.whole = b.exact group by h.id, h.label, exact having exact or count(*) <= 4
""", (247,))
def control_points(t):
    """Labels with the mean point of the places that they name, or whose names begin with them."""
    d = t.destinations()
    places = d.filter("id % 5 != 0").select(F.concat("name", F.lit(" "), (F.col("id") % 9).cast("string")).alias("name"), "x", "y")
    labels = d.select("id", F.when(F.col("id") % 4 == 0, F.col("name")).otherwise(F.concat("name", F.lit(" "), (F.col("id") % 11).cast("string"))).alias("label"))
    return names.place_by_name(labels, places, "label", "name").select("id", "label", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"), "places")
