"""Timetables by service day, and tags that any key of a rule matches, on known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reachspark.functions import text
from reachspark.operators import storage, timetable

WEEK, WEEKEND = [1, 1, 1, 1, 1, 0, 0], [0, 0, 0, 0, 0, 1, 1]


@pytest.fixture(scope="module")
def running(spark):
    calendar = spark.createDataFrame([("weekday", "20260901", "20261031", WEEK), ("weekday2", "20260901", "20261031", WEEK), ("weekend", "20260901", "20261031", WEEKEND), ("expired", "20260101", "20260831", WEEK)], "service string, start string, end string, weekdays array<int>")
    exceptions = spark.createDataFrame([("special", "20260915", 1), ("weekday2", "20260915", 2), ("weekday", "20261101", 1)], "service string, date string, kind int")
    return timetable.service_days(calendar, exceptions, "20260911", "20260916")


def test_days_of_services(running):
    days = {}
    for r in running.collect():
        days.setdefault(r.service, set()).add(r.day.day)
    assert days == {"weekday": {11, 14, 15, 16}, "weekday2": {11, 14, 16}, "weekend": {12, 13}, "special": {15}}


def test_departures_on_their_day(spark, running):
    h = lambda x, m=0: x * 3600 + m * 60
    calls = [("A", "weekday", h(7, 10)), ("A", "weekday", h(8, 10)), ("B", "weekday", h(7, 20)), ("C", "special", h(10, 30)), ("A", "weekend", h(7, 30)), ("A", "weekday2", h(7, 40)), ("A", "expired", h(7, 50)), ("A", "weekday", h(9)), ("N", "weekend", h(31, 30))]
    rows = spark.createDataFrame([(*c, None, "0") for c in calls] + [("X", "weekday", h(8), "1", " 1 "), ("Y", "weekday", h(8), "1", ""), ("Z", "weekday", h(8), "0", "1")], "stop string, service string, seconds int, pickup string, drop_off string")
    made = timetable.departures(rows, running, h(7), h(9))
    rate = {(r.stop, r.day.day): r.per_hour for r in timetable.per_hour(made, ["stop", "day"], h(7), h(9)).collect()}
    assert rate["A", 15] == 1.0 and rate["B", 15] == 0.5 and ("C", 15) not in rate and rate["A", 12] == 0.5 and rate["A", 14] == 1.5
    # after midnight the weekend's trips run on the day after, so on Monday the 14th, not on Saturday
    assert {d for s, d in rate if s == "N"} == {13, 14}
    assert ("X", 15) not in rate and rate["Y", 15] == 0.0 and rate["Z", 15] == 0.5
    alight = {r.stop: r.alight for r in made.filter(F.col("day") == dt.date(2026, 9, 15)).collect()}
    assert alight["Y"] is True and alight["Z"] is False
    assert timetable.departures(rows, running, h(10), h(12)).select("stop").distinct().collect() == [("C",)]


def test_lines_and_rides_of_trips_of_a_day(spark):
    calls = []
    for day in (1, 2):
        for trip, route, stops, start in ((1, "NX1", "ABC", 7.5), (2, "NX1", "ABC", 8.5), (3, "NX1", "CD", 8.8), (4, "STH", "PA", 7.2), (5, "STH", "PA", 12.0)):
            calls += [(f"2026-09-0{day}", trip, route, i, s, int(start * 3600) + i // 2 * 600) for i, s in enumerate(stops)]
    rows = spark.createDataFrame(calls, "day string, trip int, route string, call int, stop string, seconds int")
    got = {r.route: (r["from"], r.to, r.main, r.main_trips, r.trips, r.patterns, r.per_hour, r.stops) for r in timetable.lines(rows, "day", "trip", "route", 7 * 3600, 9 * 3600).collect()}
    # three trips a day in two hours, though the same trip numbers run on two days
    assert got == {"NX1": ("A", "C", ["A", "B", "C"], 4, 6, 2, 1.5, ["A", "B", "C", "D"]), "STH": ("P", "A", ["P", "A"], 4, 4, 1, 0.5, ["P", "A"])}
    rides = {(r.day, r.route, r.board, r.alight): (r.trips, r.median, r.most, r.headway) for r in timetable.rides(rows, ["day", "trip"], ["day", "route"], 7 * 3600, int(8.2 * 3600), 3600).collect()}
    assert rides["2026-09-01", "NX1", "A", "C"] == (1, 10.0, 10.0, 72.0) and rides["2026-09-02", "NX1", "C", "D"] == (0, 0.0, 0.0, None)
    assert len(rides) == 10


def test_any_key_of_a_rule_matches(spark):
    rules = [("supermarket", {"shop": ["supermarket"]}), ("gp", {"amenity": ["doctors", "clinic"], "healthcare": ["doctor", "clinic", "centre"]}), ("pharmacy", {"amenity": ["pharmacy"], "healthcare": ["pharmacy"]}), ("library", {"amenity": ["library"]})]
    excludes = {"library": {"access": ["private", "students"]}}
    cases = [
        ({"amenity": "doctors"}, "gp"), ({"healthcare": "centre"}, "gp"), ({"amenity": "clinic"}, "gp"), ({"amenity": "clinic", "healthcare": "physiotherapist"}, None), ({"amenity": "clinic", "healthcare": ""}, "gp"),
        ({"amenity": "clinic", "healthcare": "doctor"}, "gp"), ({"amenity": "doctors", "healthcare": "dentist"}, "gp"), ({"amenity": "clinic", "healthcare": "pharmacy"}, "pharmacy"), ({"amenity": "library"}, "library"),
        ({"amenity": "library", "access": "private"}, None), ({"amenity": "library", "access": "yes"}, "library"), ({"shop": "supermarket", "amenity": "pharmacy"}, "supermarket"), ({}, None),
    ]
    rows = spark.createDataFrame([(i, tags) for i, (tags, _) in enumerate(cases)], "i int, tags map<string,string>")
    got = rows.select("i", text.match_service(F.col("tags"), rules, excludes, {"gp": ("amenity", "clinic", "healthcare")}).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [s for _, s in cases]


def test_how_many_are_slower(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 5), ("a", 7), ("a", 9), ("b", 1)], "d string, m int")
    assert sorted(tuple(r) for r in storage.slower(rows, ["d"], "m", "behind").collect()) == [("a", 5, 2), ("a", 5, 2), ("a", 7, 1), ("a", 9, 0), ("b", 1, 0)]
