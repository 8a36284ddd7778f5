"""As-of joins, polygons and lines on known answers."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from reachspark.operators import names, shapes
from reachspark.operators.asof import asof
from reachspark.plans import registry

POINTS = "array<struct<x:double,y:double>>"


def square(x, y, w, h=None):
    h = w if h is None else h
    return [(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h))]


def polygons(spark, rows, key="z"):
    return spark.createDataFrame([(k, c) for k, c in rows], f"{key} long, corners {POINTS}")


def points(spark, rows):
    return spark.createDataFrame([(k, None if x is None else float(x), None if y is None else float(y)) for k, x, y in rows], "p long, x double, y double")


# -- as of -----------------------------------------------------------------------------


def test_as_of_with_ties_gaps_and_dates_before_the_first(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 9, 2), ("a", 10, 3), ("a", 10, 3), ("a", 99, 4), ("b", 3, 5), ("c", 3, 6), (None, 3, 7), ("a", None, 8)], "k string, at int, id int")
    right = spark.createDataFrame([("a", 9, "x", 1), ("a", 9, "y", 2), ("a", 20, None, 1), ("b", 4, "late", 1), (None, 1, "null key", 1), ("a", None, "no date", 1)], "k string, at int, v string, tie int")
    got = sorted((r.id, r.v, r.tie) for r in asof(left, right, ["k"], "at", ["v", "tie"], ["tie"]).collect())
    # at 9 the greater tie; at 20 a row whose value is null is in force all the same
    assert got == [(1, None, None), (2, "y", 2), (3, "y", 2), (3, "y", 2), (4, None, 1), (5, None, None), (6, None, None), (7, None, None), (8, None, None)]
    assert asof(left.limit(0), right, ["k"], "at", ["v"], ["tie"]).count() == 0
    assert asof(left, right.limit(0), ["k"], "at", ["v"], ["tie"]).filter("v is not null").count() == 0


def test_as_of_over_many_ranges_of_one_key(spark):
    r = random.Random(3)
    left, right = [(0, r.randrange(3000), i) for i in range(2000)], [(0, r.randrange(3000), i) for i in range(150)]
    found = asof(spark.createDataFrame(left, "k int, at int, id int"), spark.createDataFrame(right, "k int, at int, v int"), ["k"], "at", ["v"], ["v"])
    best = lambda at: max(((t, v) for _, t, v in right if t <= at), default=(0, None))[1]
    assert {(x.id, x.v) for x in found.collect()} == {(i, best(at)) for _, at, i in left}


# -- polygons ----------------------------------------------------------------------------


def test_clipped_areas(spark):
    diamond = [(5.0, -1.0), (11.0, 5.0), (5.0, 11.0), (-1.0, 5.0)]
    rows = [(square(0, 0, 10), square(5, 5, 10), 25.0), (square(0, 0, 10), square(20, 0, 5), 0.0), (square(0, 0, 10), square(2, 3, 4), 16.0), (square(2, 3, 4), square(0, 0, 10), 16.0), (square(0, 0, 10), square(10, 0, 10), 0.0)]
    rows += [(square(0, 0, 10), diamond, 100 - 4 * 4 * 4 / 2), (square(0, 0, 4), [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)], 8.0), ([], square(0, 0, 1), 0.0)]
    # not convex: an L in a square
    rows += [([(0.0, 0.0), (6.0, 0.0), (6.0, 2.0), (2.0, 2.0), (2.0, 6.0), (0.0, 6.0)], square(1, 1, 10), 5 + 4.0)]
    got = spark.createDataFrame(rows, f"a {POINTS}, b {POINTS}, want double").select("want", F.abs(shapes.signed_area(shapes.clip(F.col("a"), F.col("b")))).alias("got")).collect()
    assert [round(r.got, 9) for r in got] == [r.want for r in got]


def test_area_cover_of_disjoint_zones(spark):
    cells = polygons(spark, [(k, square(10 * (k % 5) + 3, 10 * (k // 5) + 4, 10)) for k in range(25)], "c")
    zones = polygons(spark, [(k, square(20 * (k % 2), 20 * (k // 2), 20)) for k in range(4)] + [(9, [])])
    got = shapes.area_cover(cells, zones, "c", "z", 7.0)
    share = {(r.c, r.z): r.share for r in got.collect()}
    whole = lambda c, z: max(0, min(10 * (c % 5) + 13, 20 * (z % 2) + 20) - max(10 * (c % 5) + 3, 20 * (z % 2))) * max(0, min(10 * (c // 5) + 14, 20 * (z // 2) + 20) - max(10 * (c // 5) + 4, 20 * (z // 2))) / 100
    assert share == {(c, z): pytest.approx(whole(c, z)) for c in range(25) for z in range(4) if whole(c, z) > 0}
    assert got.groupBy("c").agg(F.sum("share").alias("s")).filter("s > 1.000001").count() == 0


def test_pairs_are_cut_in_batches_as_one_by_one(spark):
    r = random.Random(8)
    around = lambda x, y, n, w, start=0.0: [(x + w * math.cos(start + 2 * math.pi * k / n), y + w * math.sin(start + 2 * math.pi * k / n)) for k in range(n)]
    cells = [(k, around(r.uniform(0, 100), r.uniform(0, 100), 6, 10)) for k in range(40)]
    cells += [(50, [(0.0, 0.0), (60.0, 0.0), (60.0, 20.0), (20.0, 20.0), (20.0, 60.0), (0.0, 60.0)]), (51, []), (52, None), (53, [(5.0, 5.0), None, (9.0, 5.0), (9.0, 9.0)])]
    zones = [(k, around(r.uniform(0, 100), r.uniform(0, 100), r.choice([3, 4, 5, 9]), r.choice([4, 15, 60]), r.random())) for k in range(25)]
    zones += [(k, square(r.randrange(80), r.randrange(80), r.choice([1, 30]), 40)) for k in range(30, 40)] + [(50, square(-500, -500, 1000)), (51, [])]
    a, b = polygons(spark, cells, "c"), polygons(spark, zones)
    found = shapes.area_cover(a, b, "c", "z", 20.0)
    each = a.filter("c < 52").crossJoin(b.withColumnRenamed("corners", "zone")).withColumn("part", shapes.clip(F.col("corners"), F.col("zone")))
    area = lambda c: F.abs(shapes.signed_area(F.col(c)))
    want = {(x.c, x.z): x.share for x in each.filter("size(corners) > 0 and size(zone) > 0").select("c", "z", F.least(F.lit(1.0), area("part") / area("corners")).alias("share")).filter("share > 1e-9").collect()}
    assert {(x.c, x.z): x.share for x in found.collect()} == want and len(want) > 300
    rounded = {(x.c, x.z): x.share for x in shapes.area_cover(a, b, "c", "z", 20.0, digits=2).collect()}
    assert rounded == {k: pytest.approx(v, abs=0.0051) for k, v in want.items()} and all(v == round(v, 2) for v in rounded.values())
    # one expression for each pair took half a millisecond
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan


def test_cells_without_an_area_have_no_share(spark):
    cells = polygons(spark, [(1, square(0, 0, 4)), (2, [(1.0, 1.0), (3.0, 1.0)]), (3, [(2.0, 2.0)])], "c")
    assert shapes.area_cover(cells, polygons(spark, [(7, square(0, 0, 2, 4))]), "c", "z", 4.0).collect() == [(1, 7, 0.5)]


def test_shape_of_many_cells_goes_out_in_parts(spark, monkeypatch):
    monkeypatch.setattr(shapes, "_CELLS_A_PART", 100)
    monkeypatch.setattr(shapes, "_CELLS_A_TASK", 500)
    one = polygons(spark, [(0, square(0, 0, 4))], "k").select("corners")
    rows = spark.range(1000).select(F.col("id").cast("string").alias("c")).crossJoin(one).unionByName(polygons(spark, [(2000, square(2, 0, 4))], "c").withColumn("c", F.col("c").cast("string")))
    found = shapes.area_cover(rows, polygons(spark, [(7, square(0, 0, 2, 4)), (8, square(3, 0, 9))]), "c", "z", 4.0, layered=True)
    assert sorted(found.groupBy("z", "share").agg(F.count("*"), F.countDistinct("c")).collect()) == [(7, 0.5, 1000, 1000), (8, 0.25, 1000, 1000), (8, 0.75, 1, 1)]
    tasks = found.filter("z = 7").groupBy(F.spark_partition_id()).count().count()
    assert tasks > 1


def test_shares_are_rounded_before_cells_take_them(spark):
    """Each of the rows of the result, cells times zones, was rounded."""
    plan = registry.QUERIES["area_cover"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan[: plan.index("Join")] and "round(" in plan


@pytest.mark.parametrize("size", [3.0, 40.0])
def test_boxes_of_all_sizes_meet_once(spark, size):
    r = random.Random(int(size))
    boxes = lambda n: [(i, (x := r.uniform(-500, 500)), (y := r.uniform(-500, 500)), x + r.choice([0, 2, 300]), y + r.choice([0, 5, 90])) for i in range(n)]
    a, b = boxes(120), boxes(80)
    left, right = spark.createDataFrame(a, "a long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(b, "b long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((x.a, x.b) for x in shapes.meeting(left, right, size, 10.0).collect())
    assert got == sorted((p[0], q[0]) for p in a for q in b if p[1] - 10 <= q[3] and q[1] <= p[3] + 10 and p[2] - 10 <= q[4] and q[2] <= p[4] + 10)
    assert shapes.meeting(left.limit(0), right, size).count() == 0


def test_tiles_met(spark):
    r = random.Random(6)
    tiles = [(i * 100 + j, i * 40.0, j * 40.0) for i in range(-3, 5) for j in range(-2, 6) if (i + j) % 3]
    ends = [(r.randrange(-200, 300), r.randrange(-200, 300), r.choice([0, 20, 40, 95]), r.choice([0, 20, 80])) for _ in range(300)] + [(900, 900, 5, 5), (-10**9, -10**9, 2 * 10**9, 2 * 10**9)]
    boxes = [(k, float(x), float(y), float(x + w), float(y + h)) for k, (x, y, w, h) in enumerate(ends)] + [(990, None, 1.0, 2.0, 2.0)]
    left = spark.createDataFrame(boxes, "k long, x0 double, y0 double, x1 double, y1 double")
    right = spark.createDataFrame([(t, x, y, x + 40, y + 40) for t, x, y in tiles], "t long, x0 double, y0 double, x1 double, y1 double")
    for margin in (0.0, 20.0):
        got = {x.k: (x.tiles, x["first"], x["last"]) for x in shapes.tiles_met(left, right, "t", 40.0, margin).collect()}
        expected = {}
        for k, x0, y0, x1, y1 in boxes:
            met = [] if x0 is None else [t for t, x, y in tiles if x <= x1 + margin and x + 40 >= x0 - margin and y <= y1 + margin and y + 40 >= y0 - margin]
            expected[k] = (len(met), min(met, default=None), max(met, default=None))
        assert got == expected and got[300] == got[990] == (0, None, None) and got[301][0] == len(tiles)
        assert {x.tiles for x in shapes.tiles_met(left, right.limit(0), "t", 40.0, margin).collect()} == {0}


def test_rides_are_not_paired_with_tiles(spark):
    """Every ride went to a few grid buckets, with all rides of a bucket in one task."""
    found = registry.QUERIES["tiles_around"](spark, "/root/testdata/sf0.001")
    assert "_bx" not in found._jdf.queryExecution().optimizedPlan().toString()


def to_segment(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = 0 if dx == dy == 0 else max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def test_nearest_line(spark):
    r = random.Random(2)
    lines = [(k, [(r.uniform(0, 3000), r.uniform(0, 3000)) for _ in range(r.randrange(1, 5))]) for k in range(25)] + [(50, []), (51, [(9000.0, 9000.0), (9000.0, 9000.0)])]
    at = [(k, r.uniform(0, 3000), r.uniform(0, 3000)) for k in range(80)] + [(90, 9003, 9004), (91, None, 1), (92, 60000, 60000)]
    got = {x.p: (round(x.d, 6), x.z) for x in shapes.nearest_line(points(spark, at), polygons(spark, lines), ["p"], "z", 5.0, 2500.0).collect()}
    best = {}
    for k, x, y in at:
        if x is not None:
            d = min((to_segment((x, y), a, b), z) for z, c in lines if c for a, b in (itertools.pairwise(c) if len(c) > 1 else [(c[0], c[0])]))
            if d[0] <= 2500:
                best[k] = round(d[0], 6), d[1]
    assert got == best and got[90] == (5.0, 51)


def test_inside_else_nearest(spark):
    zones = polygons(spark, [(1, square(0, 0, 10)), (2, square(5, 5, 10)), (3, square(100, 0, 50)), (4, [(0.0, 100.0), (20.0, 100.0), (20.0, 120.0), (10.0, 105.0), (0.0, 120.0)])])
    at = points(spark, [(1, 2, 2), (2, 7, 7), (3, 20, 2), (4, 98, 20), (5, 500, 500), (6, 10, 115), (7, None, 2), (8, 12, 13)])
    got = {x.p: (x.z, None if x.d is None else round(x.d, 4)) for x in shapes.inside_else_nearest(at, zones, ["p"], "z", 8.0, 30.0).collect()}
    notch = round(to_segment((10, 115), (20, 120), (10, 105)), 4)  # in the notch: outside, nearest to its sides
    assert got == {1: (1, 0.0), 2: (1, 0.0), 3: (2, round(math.hypot(5, 3), 4)), 4: (3, 2.0), 5: (None, None), 6: (4, notch), 7: (None, None), 8: (2, 0.0)}


def test_touching(spark):
    zones = [(1, square(0, 0, 10)), (2, square(13, 14, 10)), (3, square(2, 2, 3)), (4, square(23, 0, 1, 14)), (5, square(-5, 4, 100, 1)), (6, square(200, 200, 1))]
    pairs = lambda m: sorted((r.a, r.b) for r in shapes.touching(polygons(spark, zones), "z", m, 20.0).collect())
    # 3 lies in 1 without touching its sides, 5 crosses 1, 3 and 4
    assert pairs(0.0) == [(1, 3), (1, 5), (3, 5), (4, 5), (2, 4)] or pairs(0.0) == sorted([(1, 3), (1, 5), (2, 4), (3, 5), (4, 5)])
    assert pairs(5.0) == sorted([(1, 2), (1, 3), (1, 5), (2, 4), (3, 5), (4, 5)])
    assert pairs(9.0) == sorted([(1, 2), (1, 3), (1, 5), (2, 4), (2, 5), (3, 5), (4, 5)])


def test_outlines(spark):
    ring = [(1, square(x, y, 1)) for x in range(3) for y in range(3) if (x, y) != (1, 1)]  # a hole
    apart = [(2, square(0, 0, 1)), (2, square(1, 1, 1)), (2, square(5, 5, 2))]  # two touch at a corner
    long = [(3, square(x, 0, 1)) for x in range(70)]
    rows = polygons(spark, [*ring, *apart, *long], "g")
    got = sorted((r.g, len(r.corners), r.area) for r in shapes.dissolve(rows, "g").collect())
    assert got == [(1, 4, -1.0), (1, 12, 9.0), (2, 4, 1.0), (2, 4, 1.0), (2, 4, 4.0), (3, 142, 70.0)]
    for r in shapes.dissolve(rows, "g").collect():
        c = [(p.x, p.y) for p in r.corners]
        assert c[0] == tuple(r.ring) and all(abs(a[0] - b[0]) + abs(a[1] - b[1]) in (1, 2) for a, b in zip(c, c[1:] + c[:1], strict=True))
    assert shapes.dissolve(rows.limit(0), "g").count() == 0


# -- lines and stops -----------------------------------------------------------------------


def test_part_of_a_line(spark):
    line = [(0.0, 0.0), (0.001, 0.0), (0.002, 0.0), (0.003, 0.0)]
    rows = [(line, (0.0029, 0.0), (0.0001, 0.0)), ([(174.7, -36.8), (174.71, -36.8)], (174.7, -36.8), (174.75, -36.9)), (line, (0.0001, 0.0), (0.0002, 0.0))]
    got = spark.createDataFrame(rows, f"l {POINTS}, a struct<x:double,y:double>, b struct<x:double,y:double>").select(shapes.part_of_line(F.col("l"), F.col("a"), F.col("b"), 150.0, shapes.degree_metres).alias("r")).collect()
    # against the line's direction, both ends included; too far; one nearest vertex
    assert [tuple(p) for p in got[0].r.points] == [(0.0029, 0.0), (0.003, 0.0), (0.002, 0.0), (0.001, 0.0), (0.0, 0.0), (0.0001, 0.0)]
    assert got[0].r.off == pytest.approx(2 * 0.0001 * 111320, rel=1e-6) and got[1].r is None and got[2].r is None


def test_shape_with_the_least_offset(spark):
    lines = spark.createDataFrame([(1, 7, [(0.0, 30.0), (500.0, 30.0)]), (2, 7, [(0.0, 10.0), (250.0, 10.0), (500.0, 10.0)]), (3, 7, [(0.0, -10.0), (500.0, -10.0)]), (4, 8, [(0.0, 0.0), (9.0, 0.0)])], f"shape int, line int, corners {POINTS}")
    rides = spark.createDataFrame([(1, 7, (0.0, 0.0), (500.0, 0.0)), (2, 7, (0.0, 900.0), (500.0, 0.0)), (3, 9, (0.0, 0.0), (1.0, 0.0)), (4, 7, (500.0, 20.0), (250.0, 20.0))], "ride int, line int, a struct<x:double,y:double>, b struct<x:double,y:double>")
    got = {r.ride: (r.shape, r.off, len(r.points)) for r in shapes.ride_shapes(rides, lines, ["ride"], "line", "shape").collect()}
    assert got == {1: (2, 20.0, 5), 4: (2, 20.0, 4)}


def test_rides_meet_shapes_some_at_a_time(spark):
    lines = [(k, 7, [(0.0, 100.0 - k), (250.0, 100.0 - k), (500.0, 100.0 - k)]) for k in range(40)] + [(40, 7, None), (41, 7, []), (42, 7, [(0.0, None), (500.0, 0.0)]), (43, 8, [(0.0, 0.0), (0.0, 0.0)])]
    rides = [(1, 7, (0.0, 0.0), (500.0, 0.0)), (2, 7, (500.0, 81.0), (0.0, 81.0)), (3, 8, (0.0, 0.0), (0.0, 0.0)), (4, 7, None, (1.0, 1.0))]
    pair = "struct<x:double,y:double>"
    found = shapes.ride_shapes(spark.createDataFrame(rides, f"ride int, line int, a {pair}, b {pair}"), spark.createDataFrame(lines, f"shape int, line int, corners {POINTS}"), ["ride"], "line", "shape")
    got = {r.ride: (r.shape, r.off, [tuple(p) for p in r.points]) for r in found.collect()}
    assert got == {1: (39, 122.0, [(0.0, 0.0), (0.0, 61.0), (250.0, 61.0), (500.0, 61.0), (500.0, 0.0)]), 2: (19, 0.0, [(500.0, 81.0), (500.0, 81.0), (250.0, 81.0), (0.0, 81.0), (0.0, 81.0)])}
    # no expression per pair of ride and shape
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "array_min" not in plan


def test_groups_found_in_order(spark):
    r = random.Random(4)
    rows = [(i, r.choice("ab"), r.choice([1, 2]), r.uniform(0, 600), r.uniform(0, 600)) for i in range(250)]
    rows += [(300 + i, "c", 1, 50.0 * i, 0.0) for i in range(40)] + [(400 + i, "d", 1, 5.0, 5.0) for i in range(30)] + [(500, "a", 1, None, 0.0), (501, None, 1, 5.0, 5.0), (502, "a", None, 1.0, 1.0)]
    groups, expected = [], {}
    for k, name, mode, x, y in rows:
        known = None not in (name, mode, x, y)
        found = next((g for g in groups if known and g[1:3] == (name, mode) and math.hypot(g[3] - x, g[4] - y) < 80), None)
        if found is None:
            found = (k, name, mode, x, y)
            if known:
                groups.append(found)
        expected[k] = found[0]
    frame = spark.createDataFrame(rows, "k int, name string, mode int, x double, y double")
    assert {x.k: x.first for x in shapes.greedy_groups(frame, "k", ["name", "mode"], 80.0).collect()} == expected
    assert shapes.greedy_groups(frame.limit(0), "k", ["name", "mode"], 80.0).count() == 0


def test_places_by_name(spark):
    places = [("Henderson North", 0, 0), ("Henderson South", 10, 20), ("Henderson South", 30, 20), ("Takapuna", 5, 5), ("Takapuna Central", 50, 50), ("Mount Eden", 7, 7), ("A One", 0, 0), ("A Two", 0, 0), ("A Three", 0, 0), ("A Four", 0, 0), ("A Five", 0, 0), (None, 1, 1), ("", 1, 1), ("Hendersonville", 99, 99)]
    labels = [(1, "Henderson"), (2, "TAKAPUNA"), (3, "Mt Eden"), (4, "A"), (5, "Nowhere"), (6, ""), (7, None), (8, "Hend")]
    got = names.place_by_name(spark.createDataFrame(labels, "id int, label string"), spark.createDataFrame([(n, float(x), float(y)) for n, x, y in places], "name string, x double, y double"), "label", "name")
    assert {r.id: (round(r.px, 3), round(r.py, 3), r.places) for r in got.collect()} == {1: (13.333, 13.333, 3), 2: (5.0, 5.0, 1), 3: (7.0, 7.0, 1)}
