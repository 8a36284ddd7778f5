"""What a school's zone is on a day, which of its maps apply to which service, and tallies of that."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Statuses whose schools count for the homes in their zone only.
ZONED = ("in_force", "upcoming_used")
STATUSES = ("in_force", "upcoming_used", "none", "no_map", "not_applied", "unclear_years")


def statuses(schools: DataFrame, zones: DataFrame, day: datetime.date, first_years: dict[str, int]) -> DataFrame:
    """(school, status, from, next_from, map_from, date_unknown, polygons) of every school.

    ``schools``: school, scheme (whether it has a zone at all), services (array), years_from.
    ``zones``: school, polygon, day (null: not known, taken as in force), years_from, years_to
    (null: all years). ``first_years``: the first year of each service.

    A school with a scheme uses all its maps in force on the day, else those of the next
    day on which one comes into force (upcoming_used). One without a scheme applies none.
    Maps of which some name years and others don't, and maps that leave one of a school's
    services without a polygon in the year in which it is entered, are unclear_years.
    ``polygons`` is a map from service to polygons in order, empty unless the school is zoned.
    """
    date = F.lit(day)
    now = F.col("day").isNull() | (F.col("day") <= date)
    dates = zones.groupBy("school").agg(
        F.count("*").alias("maps"), F.count_if(now).alias("now"), F.max(F.when(F.col("day") <= date, F.col("day"))).alias("last"), F.count_if(F.col("day").isNull()).alias("unknown"), F.min(F.when(F.col("day") > date, F.col("day"))).alias("next")
    )
    found = schools.select("school", F.coalesce("scheme", F.lit(False)).alias("scheme"), F.coalesce("services", F.array().cast("array<string>")).alias("services"), "years_from").join(dates, "school", "left")
    some, inside = F.coalesce(F.col("maps") > 0, F.lit(False)), F.coalesce(F.col("now") > 0, F.lit(False))
    base = (
        F.when(~some, F.when(F.col("scheme"), "no_map").otherwise("none")).when(~F.col("scheme"), F.when(inside, "not_applied").otherwise("none"))
        .when(inside, "in_force").otherwise("upcoming_used")
    )
    found = found.withColumn("status", base)
    zoned = found.filter(F.col("status").isin(*ZONED))

    # of the maps in use: whether some name years and others don't, and those of each service's entry year
    used = zones.join(zoned.select("school", F.col("status").alias("_s"), F.col("next").alias("_n"), "services", F.col("years_from").alias("_from")), "school")
    used = used.filter(F.when(F.col("_s") == "in_force", now).otherwise(F.col("day") == F.col("_n")))
    mixed = used.groupBy("school").agg((F.count_if(F.col("years_from").isNull()) * F.count_if(F.col("years_from").isNotNull()) > 0).alias("mixed"))
    first = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in first_years.items() for x in kv]), F.col("service")), F.lit(1)) if first_years else F.lit(1)
    each = used.withColumn("service", F.explode("services")).withColumn("year", F.greatest(first, F.coalesce("_from", F.lit(0))))
    each = each.filter(F.col("years_from").isNull() | F.col("year").between(F.col("years_from"), F.col("years_to")))
    of = each.groupBy("school", "service").agg(F.array_sort(F.collect_set("polygon")).alias("p")).groupBy("school").agg(F.map_from_entries(F.collect_list(F.struct("service", "p"))).alias("polygons"))
    found = found.join(mixed, "school", "left").join(of, "school", "left")
    none = F.create_map().cast(of.schema["polygons"].dataType)
    isin = F.col("status").isin(*ZONED)
    unclear = isin & (F.col("mixed") | (F.size(F.array_except("services", F.coalesce(F.map_keys("polygons"), F.array().cast("array<string>")))) > 0))
    known = F.when(F.col("status") == "in_force", F.col("last")).when(F.col("status") == "upcoming_used", F.col("next"))
    return found.select(
        "school", F.when(unclear, "unclear_years").otherwise(F.col("status")).alias("status"), known.alias("from"), F.when((F.col("status") == "in_force") | ((F.col("status") == "none") & some), F.col("next")).alias("next_from"),
        F.when(F.col("status") == "not_applied", F.col("last")).alias("map_from"), ((F.col("status") == "in_force") & (F.coalesce("unknown", F.lit(0)) > 0)).alias("date_unknown"),
        F.when(isin & ~unclear, F.coalesce("polygons", none)).otherwise(none).alias("polygons"),
    )


def tally(status: DataFrame, schools: DataFrame) -> DataFrame:
    """(service, schools, a count for each status, zoned, open): schools by the status of their zones, for each service. ``schools``: school, services."""
    rows = schools.select("school", F.explode("services").alias("service")).join(status.select("school", "status"), "school")
    count = rows.groupBy("service").agg(F.count("*").alias("schools"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    return count.withColumns({"zoned": F.col("in_force") + F.col("upcoming_used"), "open": F.col("none")})


def upcoming(status: DataFrame, names: DataFrame) -> DataFrame:
    """(from, school, name, applied): zones that start after the day, and whether the school uses one already."""
    used = F.col("status") == "upcoming_used"
    rows = status.filter(used | F.col("next_from").isNotNull()).select(F.when(used, F.col("from")).otherwise(F.col("next_from")).alias("from"), "school", used.alias("applied"))
    return rows.join(names, "school", "left").select("from", "school", "name", "applied")
