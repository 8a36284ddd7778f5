"""Every registered query of the library against its SQL, and operators on known answers."""

import ast
import pathlib

import duckdb
import pytest
from pyspark.sql import functions as F

from reachspark.functions import text
from reachspark.operators import areas, choices, fares, gravity, graphs, measures, merge, people, spatial, stats, storage, timetable
from reachspark.operators.common import ROWS_A_TASK, dealt
from reachspark.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    result = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    assert not [c for c in result.description if "HUGE" in str(c[1]) or "DECIMAL" in str(c[1])]
    expected = sorted(repr(tuple(r[columns.index(c)] for c in order)) for r in result.fetchall())
    assert sorted(repr(tuple(r[c] for c in order)) for r in df.collect()) == expected


def test_nothing_outside_imports_the_training_data_subpackage():
    root = pathlib.Path(__file__).parents[1] / "reachspark"
    for path in root.rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") or n == "corpus_pipeline" for n in names), path


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_merge_known_answers(spark):
    pt = spark.createDataFrame([("a", 26, 23, 30), ("c", 9, 9, 9), ("e", 12, 10, 14), ("f", 30, 23, None), ("g", 50, 45, None)], "o string, minutes int, lo int, hi int")
    walk = spark.createDataFrame([("a", 15), ("b", 22), ("c", 9), ("e", 20), ("f", 25), ("g", 40)], "o string, minutes int")
    got = merge.merge_walk(pt, walk, ["o"], 60, spread=True)
    assert rows(got, "o", "minutes", "r5", "walk_quicker", "lo", "hi") == [("a", 15, 26, True, 15, 15), ("b", 22, None, True, 22, 22), ("c", 9, 9, True, 9, 9), ("e", 12, 12, False, 10, 14), ("f", 25, 30, True, 23, 25), ("g", 40, 50, True, 40, 40)]
    slow = merge.merge_walk(pt.limit(0), spark.createDataFrame([("a", 15), ("b", 45), ("c", 46), ("d", 3)], "o string, minutes int"), ["o"], 60, 4.8 / 3.6)
    assert rows(slow, "o", "minutes") == [("a", 20), ("b", 60), ("d", 4)]


def test_two_step_catchment(spark):
    pairs = spark.createDataFrame([(1, 10, 5), (2, 10, 5), (1, 20, 5)], "origin int, destination int, minutes int")
    weights = spark.createDataFrame([(10, 100.0), (20, 50.0)], "destination int, weight double")
    demand = spark.createDataFrame([(1, 10.0), (2, 30.0), (3, 10.0)], "origin int, demand double")
    got = {r.origin: r.access for r in measures.competition_adjusted(pairs, weights, demand, 30).collect()}
    assert got[3] == 0 and sum(got[o] * d for o, d in ((1, 10), (2, 30), (3, 10))) / 50 == pytest.approx(1)


def test_statistics_known_answers(spark):
    ten = spark.createDataFrame([("g", i, float(i), 1.0) for i in range(1, 11)], "g string, k int, v double, w double")
    assert stats.palma(ten, "v", "w", "k", ["g"]).first().palma == pytest.approx(4.0)
    four = ten.filter("k <= 4")
    assert stats.quantile(four, "v", "w", "k", ["g"]).first().q == 2
    three = spark.createDataFrame([("g", 1, 1.0, 50.0), ("g", 2, 2.0, 900.0), ("g", 3, 3.0, 50.0)], "g string, k int, v double, w double")
    assert rows(gravity.deciles(three, "v", "w", "k", ["g"]), "k", "decile") == [(1, 1), (2, 10), (3, 10)]
    tied = spark.createDataFrame([("g", 1, 1.0, 1.0), ("g", 2, 1.0, 3.0), ("g", 3, 2.0, 6.0)], "g string, k int, v double, w double")
    assert rows(stats.tied_bands(tied, "v", "w", ["g"]), "k", "band") == [(1, 1), (2, 1), (3, 6)]
    both = [stats.concentration(ten.withColumn("r", r), "v", "w", "r", ["g"]).first().concentration for r in (F.col("v"), -F.col("v"))]
    assert both[0] == pytest.approx(-both[1]) and both[0] != 0


def test_fares_known_answers(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "C")], "a string, b string")
    assert {(r.a, r.b): r.zones for r in fares.zone_distance(edges, 4).collect()}[("A", "C")] == 3
    one = spark.range(1).select(*[fares.affordable_zones(F.array(F.lit(3.0), F.lit(5.0)), F.lit(b), 2).alias(f"b{i}") for i, b in enumerate((6.0, 5.9, 10.0))]).first()
    assert tuple(one) == (1, 0, 2)
    assert spark.range(1).select(fares.week_cost(F.lit(5.0), 7, 8.0, 50.0).alias("c")).first().c == 50.0


def test_largest_remainder(spark):
    df = spark.createDataFrame([(1, 1, 3.6, 12.0), (1, 2, 7.7, 12.0), (1, 3, 0.9, 12.0)], "g int, k int, v double, total double")
    assert rows(people.whole_parts(df, ["g"], "k", "v", "total"), "k", "whole") == [(1, 3), (2, 8), (3, 1)]


def test_every_order_and_every_source_has_a_result(spark):
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    got = registry.QUERIES["largest_remainder_all"](spark, FOLDER)
    assert got.select("o_orderkey", "l_linenumber").distinct().count() == got.count() == lines.select("l_orderkey", "l_linenumber").distinct().count()
    chain = spark.createDataFrame([(i, i + 1, 2.0) for i in range(20)] + [(0, 9, 40.0)], "src int, dst int, len double")
    paths = graphs.shortest(chain, spark.createDataFrame([(0,), (3,)], "source int"), 30.0)
    assert rows(paths, "source", "node", "cost") == sorted((s, n, 2.0 * (n - s)) for s in (0, 3) for n in range(s, min(20, s + 15) + 1))


def test_slowest_of_groups_needs_all(spark):
    df = spark.createDataFrame([(1, 5), (1, 9), (2, 5), (2, None)], "c int, m int")
    assert rows(df.groupBy("c").agg(choices.slowest(F.col("m"), 2).alias("m")), "c", "m") == [(1, 9), (2, None)]


def test_reasons_take_the_first_rule_and_ties_the_lower_code(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (1, 9, 90.0), (2, 0, 9.0)], "a int, r int, w double")
    assert rows(areas.modal_reason(df, ["a"], "r", "w"), "a", "r") == [(1, 1), (2, 0)]


def test_clock_beyond_a_day_and_malformed(spark):
    df = spark.createDataFrame([("25:10:05",), ("x",), (None,), ("1:2",)], "c string").select(timetable.seconds(F.col("c")).alias("s"))
    assert [r.s for r in df.collect()] == [90605, None, None, None]


def test_sequences_of_errands(spark):
    seqs = lambda *x: sorted(tuple(r.seq) for r in graphs.sequences(spark, *x).collect())
    assert seqs(["a", "b", "c"], 2, {}) == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b")]
    assert seqs(["a", "b", "c"], 3, {"b": "a"}) == [("a", "b", "c"), ("a", "c", "b"), ("c", "a", "b")]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert rows(spatial.components(links, "a", "b"), "node", "root") == [(i, 0) for i in range(61)] + [(100, 100), (101, 100)]


def test_paths_of_many_edges_and_their_runs(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(9)] + [(0, 9, 9.5)], "src int, dst int, len double")
    paths = graphs.shortest(edges, spark.createDataFrame([(0,)], "source int"), 20.0)
    assert paths.filter("node = 9").first().path == list(range(10))
    rated = edges.select("src", "dst", (F.col("src") >= 5).cast("int").alias("rating"), (F.col("src") == 7).alias("worst"))
    assert rows(graphs.runs(paths, rated).filter("node in (4, 9)"), "node", "runs", "crossings") == [(4, 1, 0), (9, 2, 1)]


def test_cells_that_reach_nothing_count(spark):
    """By hand: of 40 people 10 are within the standard; those without a pair stay in the sum."""
    cells = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 20.0)], "cell int, population double")
    found = spark.createDataFrame([(1, "gp", 5), (2, "gp", 50), (9, "gp", 1)], "cell int, service string, minutes int")
    every = measures.for_every_cell(cells, ["gp", "shop"], found, "service", ["minutes"])
    assert rows(every.na.fill(-1, ["minutes"]), "cell", "service", "minutes") == [(1, "gp", 5), (1, "shop", -1), (2, "gp", 50), (2, "shop", -1), (3, "gp", -1), (3, "shop", -1)]
    share = every.groupBy("service").agg(stats.share(F.col("minutes") <= 10, F.col("population")).alias("share"))
    assert rows(share, "service", "share") == [("gp", 0.25), ("shop", 0.0)]


def test_point_in_polygon(spark):
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    square = F.array(corner(0.0, 0.0), corner(4.0, 0.0), corner(4.0, 4.0), corner(0.0, 4.0))
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (2.0, 3.9)], "x double, y double")
    assert [r.i for r in df.select(spatial.inside(F.col("x"), F.col("y"), square).alias("i")).collect()] == [True, False, True]


def test_tags_and_names(spark):
    df = spark.createDataFrame([('"a"=>"1", "b"=>"x, \\"y\\"", "a"=>"2"', "Saint Ōmāpere  Mount-School")], "t string, n string")
    r = df.select(text.tags(F.col("t")).alias("t"), text.fold_name(F.col("n")).alias("n"), text.number_in(F.lit("z12/b3")).alias("k")).first()
    assert r.t["a"] == "1" and r.n == "st omapere mt school" and r.k == 3


def test_diff_and_stable_ids(spark):
    a = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "k int, v int")
    b = spark.createDataFrame([(1, 5), (2, 7), (3, None), (4, 1)], "k int, v int")
    assert rows(storage.build_diff(a, b, ["k"], "v"), "k", "change") == [(2, "changed"), (4, "added")]
    ids = storage.stable_ids(spark.createDataFrame([("x",), ("a",), ("b",)], "n string"), spark.createDataFrame([("x", 7)], "n string, id long"), "n")
    assert rows(ids, "n", "id") == [("a", 8), ("b", 9), ("x", 7)]


@pytest.mark.parametrize("name", ["pt_or_walk_merge", "service_nearest", "gravity_score_exp"])
def test_scans_are_pruned(spark, name):
    plan = registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan and "PythonUDF" not in plan


def test_tags_are_read_once_for_all_rules(spark):
    raw = spark.createDataFrame([('"shop"=>"bakery","amenity"=>"clinic","amenity"=>"pharmacy"',), ("",), (None,)], "raw string")
    matched = raw.select(text.match_service(text.tags(F.col("raw")), [("gp", {"amenity": ["clinic"]}), ("food", {"shop": ["bakery"]}), ("drugs", {"amenity": ["pharmacy"]})], {"gp": {"shop": ["butcher"]}}).alias("m"))
    assert [r.m for r in matched.collect()] == ["gp", None, None]
    assert matched._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 3


def test_tasks_grow_in_number(spark):
    rows = spark.range(100).withColumn("k", F.col("id") % 7)
    assert dealt(rows, ["k"], 30 * ROWS_A_TASK + 1).rdd.getNumPartitions() == 31
    assert dealt(rows, ["k"], 0).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in dealt(rows, ["k"], 5).collect()) == list(range(100))
