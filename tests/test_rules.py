"""Zone statuses, payment by the hour, class edges and chains of areas on known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reachspark.operators import areas, fares, zones

D = dt.date


def test_zone_statuses(spark):
    schools = [("a", True, ["primary"], None), ("b", True, ["primary"], None), ("c", False, ["primary"], None), ("d", True, ["primary"], None), ("e", False, ["primary"], None), ("f", False, ["primary"], None), ("g", True, ["primary", "secondary"], None), ("h", True, ["primary"], None), ("i", True, ["primary", "secondary"], None), ("j", None, None, None), ("k", True, ["secondary"], 11)]
    maps = [
        ("a", 1, D(2020, 1, 1), None, None), ("a", 2, None, None, None), ("a", 3, D(2030, 1, 1), None, None), ("b", 4, D(2028, 1, 1), None, None), ("b", 5, D(2029, 1, 1), None, None), ("c", 6, D(2020, 5, 5), None, None), ("e", 7, D(2030, 1, 1), None, None),
        ("g", 8, D(2020, 1, 1), 1, 8), ("g", 9, D(2020, 1, 1), 9, 13), ("h", 10, D(2020, 1, 1), 1, 8), ("h", 11, D(2021, 1, 1), None, None), ("i", 12, D(2020, 1, 1), 1, 8), ("k", 13, D(2020, 1, 1), 9, 10), ("k", 14, D(2020, 1, 1), 11, 13),
    ]
    rows = spark.createDataFrame(schools, "school string, scheme boolean, services array<string>, years_from int")
    found = zones.statuses(rows, spark.createDataFrame(maps, "school string, polygon int, day date, years_from int, years_to int"), D(2026, 9, 15), {"primary": 1, "secondary": 9})
    got = {r.school: (r.status, r["from"], r.next_from, r.map_from, r.date_unknown, r.polygons) for r in found.collect()}
    assert got == {
        "a": ("in_force", D(2020, 1, 1), D(2030, 1, 1), None, True, {"primary": [1, 2]}), "b": ("upcoming_used", D(2028, 1, 1), None, None, False, {"primary": [4]}), "c": ("not_applied", None, None, D(2020, 5, 5), False, {}), "d": ("no_map", None, None, None, False, {}),
        "e": ("none", None, D(2030, 1, 1), None, False, {}), "f": ("none", None, None, None, False, {}), "g": ("in_force", D(2020, 1, 1), None, None, False, {"primary": [8], "secondary": [9]}), "h": ("unclear_years", D(2021, 1, 1), None, None, False, {}),
        "i": ("unclear_years", D(2020, 1, 1), None, None, False, {}), "j": ("none", None, None, None, False, {}), "k": ("in_force", D(2020, 1, 1), None, None, False, {"secondary": [14]}),
    }
    tally = {r.service: (r.schools, r.in_force, r.upcoming_used, r.none, r.no_map, r.not_applied, r.unclear_years, r.zoned, r.open) for r in zones.tally(found, rows.filter("services is not null")).collect()}
    assert tally == {"primary": (9, 2, 1, 2, 1, 1, 2, 3, 2), "secondary": (3, 2, 0, 0, 0, 0, 1, 2, 0)}
    names = rows.select("school", F.upper("school").alias("name"))
    assert sorted((r["from"], r.school, r.name, r.applied) for r in zones.upcoming(found, names).collect()) == [(D(2028, 1, 1), "b", "B", True), (D(2030, 1, 1), "a", "A", False), (D(2030, 1, 1), "e", "E", False)]


def test_free_hours_however_they_are_written():
    assert fares.free_hours({}) == [(9.0, 24.0)] and fares.free_hours({"free_from": "08:30"}) == [(8.5, 24.0)]
    assert fares.free_hours({"free_from": "09:00", "free_until": "15:00"}) == [(9.0, 15.0)]
    assert fares.free_hours({"free_from": "09:00", "free_until": "15:00", "free_after": "18:30"}) == [(9.0, 15.0), (18.5, 24.0)]
    assert fares.free_hours({"free_hours_weekday": [[9, 15], [18.5, 24]], "free_from": "01:00"}) == [(9.0, 15.0), (18.5, 24.0)]


def test_payment_by_the_hour(spark):
    rows = spark.createDataFrame([(8.0, True), (9.0, True), (15.0, True), (20.0, True), (8.0, False), (None, True)], "hour double, weekday boolean")
    spans = [(9.0, 15.0), (19.0, 24.0)]
    off = fares.is_offpeak(spans, F.col("hour"), F.col("weekday"))
    assert [r[0] for r in rows.select(off).collect()] == [False, True, False, True, True, False]
    assert [r[0] for r in rows.select(fares.is_offpeak([], F.col("hour"), F.col("weekday"))).collect()] == [False] * 6
    key = lambda known, p: [r[0] for r in rows.select(fares.payment_key(known, F.lit(p), off)).collect()][:2]
    assert key(["hop_peak", "hop_offpeak"], "hop") == ["hop_peak", "hop_offpeak"] and key(["hop", "hop_peak", "hop_offpeak"], "hop") == ["hop", "hop"]
    assert key(["cash_peak", "cash_offpeak"], "cash") == ["cash", "cash"] and key(["hop_peak"], "hop") == ["hop_peak", "hop"]
    free = lambda p: [r[0] for r in rows.select(fares.free_travel({"child_0_4": None, "gold": [(9.0, 24.0)]}, F.lit(p), F.col("hour"), F.col("weekday"))).collect()]
    assert free("child_0_4") == [True] * 6 and free("adult") == [False] * 6 and free("gold") == [False, True, True, True, True, False]


def test_prices_fall_back_to_the_adults(spark):
    prices = spark.createDataFrame([("adult", "cash", 1, 4.0), ("adult", "hop", 1, 2.0), ("child", "hop", 1, 1.0), ("student", "pass", 1, 0.5), ("adult", "cash", 2, 6.0), ("adult", "hop", 2, 3.0)], "profile string, key string, zones int, price double")
    rows = spark.createDataFrame([(1, "child", "hop", 1), (2, "child", "cash", 1), (3, "nobody", "hop", 9), (4, "student", "ticket", 0), (5, "nobody", "ticket", 1)], "i int, profile string, key string, zones int")
    assert {r.i: r.fare for r in fares.priced(rows, prices, 2).collect()} == {1: 1.0, 2: 4.0, 3: 3.0, 4: 0.5, 5: 4.0}


@pytest.mark.parametrize("values, want", [([], [1.0, 2.0, 5.0]), ([-1.0, 0.0], [1.0, 2.0, 5.0]), ([1.0] * 8, [1.0, 2.0, 5.0]), ([3.0, 7.0, 33.0, 61.0], [10.0, 40.0, 75.0]), ([501.5] * 4, [502.0, None, 502.0]), ([12.0, 12.0, 12.0, 480.0], [15.0, 20.0, 500.0])])
def test_edges_at_the_quarters(spark, values, want):
    rows = spark.createDataFrame([("g", i, v) for i, v in enumerate([*values, None])], "g string, id int, v double")
    assert [list(r.breaks) for r in areas.quartile_breaks(rows, ["g"], "v", "id").collect()] == [want]


def test_edges_around_a_standard_and_classes(spark):
    rows = spark.createDataFrame([(20, 10), (20, 11), (15, 60), (30, None)], "standard int, minutes int").withColumn("b", areas.access_breaks(F.col("standard")))
    got = [(list(r.b), r.c) for r in rows.select("b", areas.class_of(F.col("minutes"), F.col("b")).alias("c")).collect()]
    assert got == [([10, 15, 20, 30, 45], 0), ([10, 15, 20, 30, 45], 1), ([8, 11, 15, 23, 34], 5), ([15, 23, 30, 45, 60], None)]


def test_chains_leave_out_areas_of_the_same_people(spark):
    cells = [("W1", "B1", "s1", 100.0), ("W1", "B1", "s2", 200.0), ("W2", "B2", "s3", 400.0), ("W2", "B3", "s4", 300.0), ("W2", "B3", "s1", 20.0), ("W2", "B4", "s5", 0.0), (None, None, "s6", 10.0)]
    rows = spark.createDataFrame(cells, "ward string, board string, sa2 string, population double")
    got = {r.area: [(x.level, x.name, x.people) for x in r.chain] for r in areas.chain(rows, ["ward", "board", "sa2"], "sa2", "population").collect()}
    # B1 is all of W1; s3 is all of B2, which stands for it; s5 has no people; s6 lies in nothing
    assert got == {"s1": [("ward", "W1", 300.0), ("sa2", "s1", 120.0)], "s2": [("ward", "W1", 300.0), ("sa2", "s2", 200.0)], "s3": [("ward", "W2", 720.0), ("board", "B2", 400.0)], "s4": [("ward", "W2", 720.0), ("board", "B3", 320.0), ("sa2", "s4", 300.0)], "s6": [("sa2", "s6", 10.0)]}
