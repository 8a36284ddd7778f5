"""Queries on names, tags and other text."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachspark.functions import text
from reachspark.plans.registry import query


@query("destinations", """
select id, trim(regexp_replace(regexp_replace(regexp_replace(translate(lower('Saint ' || name || ' Ōtara-Mount'), 'àáâãäåāçèéêëēìíîïīñòóôõöōùúûüūýÿ', 'aaaaaaaceeeeeiiiiinoooooouuuuuyy'), '\\bsaint\\b', 'st'), '\\bmount\\b', 'mt'), '[^a-z0-9]+', ' ', 'g')) as folded from destinations
""", (448, 449, 10))
def fold_names(t):
    return t.destinations().select("id", text.fold_name(F.concat(F.lit("Saint "), "name", F.lit(" Ōtara-Mount"))).alias("folded"))


@query("destinations", """
with tag as (select id, ['doctors', 'clinic', 'pharmacy', 'library', null][id % 5 + 1] as amenity, ['doctor', 'physiotherapist', '', 'pharmacy', null, 'centre'][id % 6 + 1] as healthcare, case when id % 7 < 2 then 'private' end as access, case when kind = 'ECONOMY' then 'supermarket' end as shop from destinations)
select id, case when shop = 'supermarket' then 'supermarket'
  when amenity = 'doctors' or amenity = 'clinic' and coalesce(healthcare, '') in ('', 'doctor', 'clinic', 'centre') or healthcare in ('doctor', 'clinic', 'centre') then 'gp'
  when amenity = 'pharmacy' or healthcare = 'pharmacy' then 'pharmacy' when amenity = 'library' and access is null then 'library' end as matched from tag
""", (13, 85, 86, 87))
def tag_match(t):
    """The service of each place by its tags: any key of a rule, less exclusions and clinics of another kind."""
    of = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("id") % len(v) + 1).cast("int"))
    said = lambda key, value: F.when(value.isNotNull(), F.format_string(f'"{key}"=>"%s"', value))
    raw = F.concat_ws(",", said("amenity", of("doctors", "clinic", "pharmacy", "library", None)), said("healthcare", of("doctor", "physiotherapist", "", "pharmacy", None, "centre")), F.when(F.col("id") % 7 < 2, '"access"=>"private"'), F.when(F.col("kind") == "ECONOMY", '"shop"=>"supermarket"'))
    rules = [("supermarket", {"shop": ["supermarket"]}), ("gp", {"amenity": ["doctors", "clinic"], "healthcare": ["doctor", "clinic", "centre"]}), ("pharmacy", {"amenity": ["pharmacy"], "healthcare": ["pharmacy"]}), ("library", {"amenity": ["library"]})]
    excludes = {"library": {"access": ["private", "no", "customers", "students"]}}
    return t.destinations().select("id", text.match_service(text.tags(raw), rules, excludes, {"gp": ("amenity", "clinic", "healthcare")}).alias("matched"))


@query("schools", """
select school, years_from as first, years_to as last, cast(school as varchar) as code, 'S' || upper(substr('zone', 1, 1)) as initials, cast(least(school % 50, school % 7) as int) as ring from schools
""", (105, 452, 453, 454, 460))
def parse_names(t):
    name = F.concat(F.lit("Years "), F.coalesce(F.concat(F.col("years_from").cast("string"), F.lit("-"), F.col("years_to").cast("string")), F.lit("all")))
    first, last = text.years(name)
    ring = text.number_in(F.concat(F.lit("zone"), (F.col("school") % 50).cast("string"), F.lit("a/b"), (F.col("school") % 7).cast("string")))
    return t.schools().select("school", first.alias("first"), last.alias("last"), text.code(F.concat(F.col("school").cast("string"), F.lit(".0"))).alias("code"), text.initials(F.lit("S Zone")).alias("initials"), ring.alias("ring"))


@query("", """
select event_id, cast((h + case when h < 7 then 12 else 0 end) * 60 + m as int) as minutes, cast(case when value <= 5 then 0 when value <= 10 then 1 when value <= 20 then 2 when value > 20 then 3 end as int) as class from (select event_id, value, cast(1 + event_id % 12 as int) as h, cast(minute(ts) as int) as m from events)
""", (121, 455, 314))
def clocks_and_classes(t):
    printed = F.concat((1 + F.col("event_id") % 12).cast("string"), F.lit(":"), F.lpad(F.minute("ts").cast("string"), 2, "0"))
    return t.raw("events").select("event_id", text.clock(printed).alias("minutes"), text.breaks_class(F.col("value"), [5.0, 10.0, 20.0]).alias("class"))


@query("", """
select event_id, cast(json_extract(props, '$.k') as int) as k, user_id % 5 as owner from events where json_extract(props, '$.k') is not null
""", (4, 5))
def json_records(t):
    rows = t.raw("events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), (F.col("user_id") % 5).alias("owner"))
    return rows.filter("k is not null")


@query("", "select user_id, array_to_string(list_sort(list(distinct event_type)), '|') as kinds, count(*) as n from events group by user_id", ())
def joined_lists(t):
    return t.raw("events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("kinds"), F.count("*").alias("n"))
