"""Queries on reasons, areas and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachspark.operators import areas, measures, stats
from reachspark.operators.common import numbered
from reachspark.plans.registry import query

_WIDE = """w as (select cells.*, e.service, min(minutes) filter (where mode = 'walk') as walk, min(minutes) filter (where mode = 'bike') as bike, min(minutes) filter (where mode = 'pt') as pt, least(min(minutes) filter (where mode = 'walk'), min(minutes) filter (where mode = 'pt')) as best
  from cells cross join (select distinct service from destinations) e left join pairs on cell = origin and pairs.service = e.service group by all),
d as (select *, case when coalesce(best <= 8, false) then 0 when coalesce(bike <= 8, false) then 1 when coalesce(pt <= 16, false) then 2 when coalesce(walk <= 24, false) then 3 when population < 1000 then 4 else 9 end as reason, greatest(0.0, (coalesce(cast(best as double), 60.0) - 8) / 8) as gap from w)"""


def _diagnosed(t):
    """Every cell with every service, reached or not."""
    modes = ("walk", "bike", "pt")
    w = measures.for_every_cell(t.cells(), t.services(), measures.by_mode(t.pairs(), [F.col("origin").alias("cell"), "service"], modes), "service", list(modes))
    w = w.withColumn("best", F.least("walk", "pt"))
    rules = [(F.col("bike") <= 8, 1), (F.col("pt") <= 16, 2), (F.col("walk") <= 24, 3), (F.col("population") < 1000, 4)]
    return w.withColumn("reason", areas.diagnose(F.col("best"), 8, rules)).withColumn("gap", stats.shortfall(F.col("best"), 8.0))


@query("cells pairs", "with " + _WIDE + " select cell, service, reason from d", (83, 84, 133, 134))
def diagnose(t):
    return _diagnosed(t).select("cell", "service", "reason")


@query("cells pairs", "with " + _WIDE + " select service, reason, round(sum(population), 2) as people from d where reason not in (0, 9) group by service, reason", (306, 331))
def people_by_reason(t):
    return _diagnosed(t).filter("reason not in (0, 9)").groupBy("service", "reason").agg(F.round(F.sum("population"), 2).alias("people"))


@query("cells pairs", "with " + _WIDE + """
select service, case when grouping(quintile) = 0 then 'quintile' when grouping(council) = 0 then 'council' else 'all' end as level, coalesce(cast(quintile as varchar), council, 'all') as grp,
  round(sum(case when reason = 0 then population else 0 end) / nullif(sum(population), 0), 6) as share, round(sum(case when reason <> 0 then population else 0 end), 2) as below
from d group by grouping sets ((service), (service, quintile), (service, council))
""", (266, 304, 317))
def service_summary(t):
    rows = _diagnosed(t).select("service", "quintile", "council", "population", "reason")
    both = rows.groupingSets([[F.col("service")], [F.col("service"), F.col("quintile")], [F.col("service"), F.col("council")]], "service", "quintile", "council")
    met = F.col("reason") == 0
    out = both.agg(F.when(F.grouping("quintile") == 0, "quintile").when(F.grouping("council") == 0, "council").otherwise("all").alias("level"), F.round(stats.share(met, F.col("population")), 6).alias("share"), F.round(F.sum(F.when(~met, F.col("population")).otherwise(0.0)), 2).alias("below"))
    return out.select("service", "level", F.coalesce(F.col("quintile").cast("string"), "council", F.lit("all")).alias("grp"), "share", "below")


_MODAL = """, r as (select sa2, service, reason, sum(population) as w from d group by all),
m as (select sa2, service, coalesce(-max(case when reason not in (0, 9) and w > 0 then row(w, -reason) end)[2], 0) as reason from r group by sa2, service)"""


@query("cells pairs", "with " + _WIDE + _MODAL + """
select d.sa2, d.service, round(sum(population), 2) as people, round(sum(case when d.reason = 0 then population else 0 end) / nullif(sum(population), 0), 6) as share, any_value(m.reason) as reason from d join m on d.sa2 = m.sa2 and d.service = m.service group by d.sa2, d.service
""", (268,))
def area_summary(t):
    rows = _diagnosed(t)
    modal = areas.modal_reason(rows, ["sa2", "service"], "reason", "population")
    sums = rows.groupBy("sa2", "service").agg(F.round(F.sum("population"), 2).alias("people"), F.round(stats.share(F.col("reason") == 0, F.col("population")), 6).alias("share"))
    return sums.join(modal, ["sa2", "service"])


@query("cells pairs", "with " + _WIDE + """, a as (select sa2, service, round(sum(case when reason <> 0 then population else 0 end), 2) as below from d group by all)
select sa2, service, below, place from (select *, row_number() over (partition by service order by below desc, sa2) as place from a where below > 0) where place <= 10
""", (307, 371))
def rank_places(t):
    a = _diagnosed(t).groupBy("sa2", "service").agg(F.round(F.sum(F.when(F.col("reason") != 0, F.col("population")).otherwise(0.0)), 2).alias("below")).filter("below > 0")
    return areas.worst(a, ["service"], [F.desc("below"), "sa2"], 10)


@query("cells pairs", "with " + _WIDE + """
select sa2, service, round(sum(population), 2) as people, round(sum(case when gap > 0 then population else 0 end), 2) as missing, round(sum(case when gap > 0 then population else 0 end) / nullif(sum(population), 0), 6) as share,
  round(sum(gap * population) * 8 / nullif(sum(case when gap > 0 then population else 0 end), 0), 6) as minutes_short from d group by sa2, service
""", (316, 334))
def area_table(t):
    a = areas.area_table(_diagnosed(t), ["sa2", "service"], F.col("gap"), "population", 8.0)
    return a.select("sa2", "service", F.round("people", 2).alias("people"), F.round("missing", 2).alias("missing"), F.round("share", 6).alias("share"), F.round("minutes_short", 6).alias("minutes_short"))


@query("cells", """
with p as (select sum(population * older) / sum(population) as place from cells)
select sa2, round(sum(population * older), 4) as older, round(sum(population * older) / sum(population), 6) as share from cells, p group by sa2, place having sum(population * older) >= 300 and sum(population * older) / sum(population) >= 1.05 * place
""", (325,))
def norc_suburbs(t):
    c = t.cells().withColumn("w", F.col("population") * F.col("older"))
    place = c.agg((F.sum("w") / F.sum("population")).alias("place"))
    s = c.groupBy("sa2").agg(F.sum("w").alias("w"), F.sum("population").alias("p")).join(F.broadcast(place))  # one row
    return s.filter((F.col("w") >= 300) & (F.col("w") / F.col("p") >= 1.05 * F.col("place"))).select("sa2", F.round("w", 4).alias("older"), F.round(F.col("w") / F.col("p"), 6).alias("share"))


@query("cells", """
select segment, sa2, round(w, 2) as people from (select segment, sa2, sum(population) as w, row_number() over (partition by segment order by sum(population) desc, sa2) as k from cells group by segment, sa2) where k = 1
""", (318,))
def area_chain(t):
    return areas.parents(t.cells(), "segment", "sa2", "population").select("segment", "sa2", F.round("people", 2).alias("people"))


@query("cells", """
select sa2, round(avg(x), 6) as x, round(avg(y), 6) as y, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1, round(sum(population), 2) as people, count(*) as cells, round(greatest(sqrt((max(x) - min(x)) * (max(y) - min(y))), 100), 6) as size from cells group by sa2
""", (48, 202, 242, 243, 317, 347))
def place_list(t):
    size = F.greatest(F.sqrt((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))), F.lit(100.0))
    return t.cells().groupBy("sa2").agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.round(F.sum("population"), 2).alias("people"), F.count("*").alias("cells"), F.round(size, 6).alias("size"))


@query("cells", """
select council, x[cast(floor(n * 0.01) as int) + 1] as x0, x[n - cast(floor(n * 0.01) as int)] as x1, y[cast(floor(n * 0.01) as int) + 1] as y0, y[n - cast(floor(n * 0.01) as int)] as y1
from (select council, count(*) as n, list(x order by x) as x, list(y order by y) as y from cells group by council)
""", (350, 351))
def trimmed_extent(t):
    cells = t.cells().select("council", "cell", "x", "y")
    cut = F.floor(F.col("_rows") * 0.01)

    def ends(c):
        rows = numbered(cells, ["council"], [c, "cell"], "_k")
        at = lambda k: F.max(F.when(F.col("_k") == k, F.col(c)))
        return rows.groupBy("council").agg(at(cut + 1).alias(f"{c}0"), at(F.col("_rows") - cut).alias(f"{c}1"))

    return ends("x").join(ends("y"), "council")
