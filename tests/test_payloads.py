"""Arrays in tiles and back, damaged input, and tables that are kept current."""

import math
import random

import pytest
from pyspark.sql import functions as F

from reachspark.operators import payloads
from reachspark.plans import registry
from reachspark.streaming.maintained import Maintained, relabelled
from tests.conftest import DATA


def test_lists_and_offsets_of_a_tile(spark):
    rows = spark.createDataFrame([("w", 0, 7, 5, (9,)), ("w", 0, 3, 4, None), ("w", 2, 3, 1, (None,)), ("w", 5, 1, 1, None), ("b", 4, 8, 2, None)], "mode string, cell long, d int, m int, r5 struct<value:int>")
    cells = spark.createDataFrame([(i,) for i in range(6)], "cell long")
    got = {(r["mode"], r.tile): (r.n, r.o, r.d, r.m, r.k, r.v) for r in payloads.encode(rows, cells, ["mode"], 4, ["m", "d"], ["d", "m"], "r5").collect()}
    assert got == {("w", 0): (4, [0, 2, 2, 3, 3], [3, 7, 3], [4, 5, 1], [1, 2], [9, None]), ("w", 1): (2, [0, 0, 1], [1], [1], [], []), ("b", 0): (4, [0, 0, 0, 0, 0], [], [], [], []), ("b", 1): (2, [0, 1, 1], [8], [2], [], [])}


def test_round_trip_of_random_lists(spark):
    r = random.Random(1)
    rows = [(r.choice("xy"), c, d, r.randrange(60), r.choice([None, 1.5, 2.5]), r.choice([None, (4,), (None,)])) for c in range(40) for d in r.sample(range(50), r.choice([0, 0, 1, 7]))]
    frame = spark.createDataFrame(rows, "mode string, cell long, d int, m int, lo double, r5 struct<value:int>")
    tiles = payloads.encode(frame, spark.createDataFrame([(i,) for i in range(43)], "cell long"), ["mode"], 8, ["m", "d"], ["d", "m", "lo"], "r5").withColumn("format", F.lit(1))
    back, bad = payloads.decode(tiles, ["mode"], 8, ["d", "m", "lo"], sparse=True)
    key = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else v for v in x)
    assert sorted([(x["mode"], x.cell, x.d, x.m, x.lo, x.marked, x.value) for x in back.collect()], key=key) == sorted([(*x[:5], x[5] is not None, x[5][0] if x[5] else None) for x in rows], key=key)
    assert bad.count() == 0
    # the last offset may be left out; an array of another length than the entries is not used
    short = tiles.withColumn("o", F.slice("o", 1, F.col("n"))).withColumn("lo", F.slice("lo", 1, 1))
    again, bad = payloads.decode(short, ["mode"], 8, ["d", "m", "lo"], sparse=True)
    assert bad.count() == 0 and again.count() == len(rows) and again.drop("lo").exceptAll(back.drop("lo")).count() == 0


def test_each_kind_of_damage(spark):
    schema = "mode string, tile long, format int, n int, o array<int>, d array<int>, m array<int>, k array<int>, v array<int>"
    good = (1, 2, [0, 1, 3], [4, 5, 6], [1, 2, 3], [2], [9])
    rows = {
        "a": good, "b": (3, *good[1:]), "c": (1, 2, None, [4], [1], [], []), "d": (1, 2, [0, 1, 3], [4, 5, 6], [1, 2], [], []), "e": (1, 3, [0, 1], [4], [1], [], []), "f": (1, 2, [0, 2, 1], [4], [1], [], []), "g": (1, 2, [1, 1, 3], [4, 5, 6], [1, 2, 3], [], []),
        "h": (1, 2, [0, 1, 2], [4, 5, 6], [1, 2, 3], [], []), "i": (*good[:5], [1, 2], [9]), "j": (*good[:5], [3], [9]), "k": (*good[:5], [-1], [9]), "l": (*good[:5], None, None), "m": (None, *good[1:]), "n": (1, 2, [0, None, 3], [4, 5, 6], [1, 2, 3], [], []), "o": (2, 2, [0, 0], [], [], [], []),
    }
    back, bad = payloads.decode(spark.createDataFrame([(name, 5, *r) for name, r in rows.items()], schema), ["mode"], 10, ["d", "m"], sparse=True)
    assert {r["mode"]: r.problem for r in bad.collect()} == {"b": "format", "c": "format", "d": "more entries than values", "e": "number of offsets", "f": "order of offsets", "g": "cover of offsets", "h": "cover of offsets", "i": "more positions than values", "j": "position out of range", "k": "position out of range", "m": "format", "n": "order of offsets"}
    assert sorted(tuple(r) for r in back.filter("mode = 'a'").collect()) == [("a", 50, 0, 4, 1, False, None), ("a", 51, 0, 5, 2, False, None), ("a", 51, 1, 6, 3, True, 9)]
    assert {r["mode"] for r in back.collect()} == {"a", "l"}


def test_arrays_are_made_once(spark):
    """A filter on the problem would be moved below the arrays, and have each made again wherever the checks mention it."""
    rows = spark.range(40).selectExpr("'w' as mode", "id as cell", "id as d", "cast(id % 7 as int) as m", "if(id % 3 = 0, struct(id as value), null) as r5")
    tiles = payloads.encode(rows, rows.select("cell"), ["mode"], 8, ["m", "d"], ["d", "m"], "r5").withColumn("format", F.lit(1))
    back, bad = payloads.decode(tiles, ["mode"], 8, ["d", "m"], sparse=True)
    assert bad._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    assert back._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    assert sorted((r.cell, r.place, r.d, r.m, r.marked, r.value) for r in back.collect()) == [(i, 0, i, i % 7, i % 3 == 0, i if i % 3 == 0 else None) for i in range(40)]


def test_rows_are_read_once_and_move_before_lists_are_made(spark):
    for name in ("reach_damaged", "reach_round_trip", "zone_weights"):
        plan = registry.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("lineitem.parquet") == 1, name
        lists = plan[plan.index("collect_list(") : plan.rindex("collect_list(")]
        assert lists and "Exchange" not in lists, name


def test_offsets_with_gaps_and_without_empty_tiles(spark):
    r = random.Random(2)
    rows = [(c, d, c // 8) for c in range(70) if c // 8 not in (2, 5) for d in range(r.choice([0, 0, 1, 5]))] + [(75, 1, 9), (100, 1, 12)]  # 75 is beyond its tile's last cell, 100 in no tile
    frame, cells = spark.createDataFrame(rows, "cell long, d int, tile long"), spark.createDataFrame([(i,) for i in range(75)], "cell long")
    lists = [[d for c, d, _ in sorted(rows) if c == i] for i in range(80)]
    n = lambda tile: min(75 - 8 * tile, 8)
    expected = {tile: (n(tile), [sum(map(len, lists[8 * tile : 8 * tile + i])) for i in range(n(tile) + 1)], sum(lists[8 * tile : 8 * tile + 8], [])) for tile in range(10)}
    full = {tile: e for tile, e in expected.items() if e[2]}
    assert set(range(10)) - set(full) >= {2, 5}
    for given, empty in ((frame, True), (frame, False), (frame.drop("tile"), False), (frame.repartition("tile"), False)):
        got = payloads.encode(given, cells, [], 8, ["d"], ["d"], empty=empty).collect()
        assert {x.tile: (x.n, x.o, x.d) for x in got} == (expected if empty else full) and len(got) == len(expected if empty else full)


def test_cells_of_entries_are_not_taken_out_for_each_entry(spark):
    """The optimizer writes out what an array of cells is where it is named, in functions of an entry too."""
    rows = spark.range(40).selectExpr("id as cell", "id as d")
    for empty in (True, False):
        plan = payloads.encode(rows, rows.select("cell"), [], 8, ["d"], ["d"], empty=empty).select("tile", "o")._jdf.queryExecution().optimizedPlan().toString()
        assert "transform(arrays_zip(" in plan and ".at[" not in plan and "array_position(" not in plan


def test_positions_in_any_order_and_twice(spark):
    schema = "mode string, tile long, format int, n int, o array<int>, d array<int>, m array<int>, k array<long>, v array<int>"
    rows = [("a", 0, 1, 3, [0, 0, 4], [1, 2, 3, 4], [1, 2, 3, 4], [3, 1, 3], [7, None, 8]), ("b", 0, 1, 1, [0], [5], [6], None, [1]), ("c", 0, 1, 2, [0, 2_000_000_000], [5], [6], [], []), ("e", 0, 1, 0, [], [], [], [], [])]
    back, bad = payloads.decode(spark.createDataFrame(rows, schema), ["mode"], 10, ["d", "m"], sparse=True)
    assert sorted((r["mode"], r.cell, r.place, r.d, r.marked, r.value) for r in back.collect()) == [("a", 1, 0, 1, False, None), ("a", 1, 1, 2, True, None), ("a", 1, 2, 3, False, None), ("a", 1, 3, 4, True, 7), ("b", 0, 0, 5, False, None)]
    assert [(r["mode"], r.problem) for r in bad.collect()] == [("c", "order of offsets")]


def test_values_without_an_order_can_be_listed(spark):
    rows = spark.sql("select cell, d, map('k', d) as m from values (1L, 5), (1L, 4), (3L, 6) as t(cell, d)")
    got = payloads.encode(rows, spark.range(4).withColumnRenamed("id", "cell"), [], 4, ["d"], ["d", "m"]).first()
    assert (got.o, got.d, got.m) == ([0, 0, 2, 2, 3], [4, 5, 6], [{"k": 4}, {"k": 5}, {"k": 6}])


def test_weights(spark):
    got = spark.createDataFrame([([0.5, -1.0, 7.0, None, math.nan, math.inf],)], "w array<double>").select(payloads.weights(F.col("w"))).first()[0]
    assert got == [0.5, 0.0, 1.0, 0.0, 0.0, 0.0]


def test_columns_dense_and_sparse_and_back(spark):
    rows = [(i, float(i) / 3 if i % 2 else None, 8.5 if i == 6 else None, math.nan if i == 1 else 2.25, None) for i in range(11)]
    table = spark.createDataFrame(rows, "cell long, a double, b double, c double, e double")
    found = payloads.columns(table, 8, {"first": ["a"], "later": ["b", "c", "e"]}, {"a": 2, "b": 1, "c": 1})
    got = {(r.tile, r.name): (r.grp, r.n, r.dense, r.k, r.v) for r in found.collect()}
    assert len(got) == 8 and got[0, "a"] == ("first", 8, [None, 0.33, None, 1.0, None, 1.67, None, 2.33], None, None)
    assert got[0, "b"] == ("later", 8, None, [6], [8.5]) and got[0, "c"][2] == [2.2, None, *[2.2] * 6] and got[1, "b"] == ("later", 3, None, [], [])
    back = {r.cell: (r.a, r.b, r.c, r.e) for r in payloads.cells_of(found, 8, ["a", "b", "c", "e"]).collect()}
    assert back == {i: (None if a is None else round(a, 2), b, None if math.isnan(c) else 2.2, None) for i, a, b, c, _ in rows if not (a is None and b is None and math.isnan(c))}


# -- kept current ----------------------------------------------------------------------


def state(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_update_crash_and_recovery(spark, tmp_path):
    schema = "k int, v string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    path = f"file://{tmp_path}/t"
    with pytest.raises(ValueError, match="no table"):
        Maintained(spark, path, "k")
    table = Maintained(spark, path, "k", schema, batches=8)
    assert state(table) == []
    first = [(k, "old") for k in range(50)] + [(3, "twice")]
    with pytest.raises(ValueError, match="not said"):  # a null key is none that could change later
        table.update(frame([*first, (None, "null")]), keys(*range(50), None))
    table.update(frame(first), keys(*range(50)))
    for where in ("data", "manifest"):
        with pytest.raises(RuntimeError, match="stopped"):
            table.update(frame([(3, where)]), keys(3, 4), crash=where)
        found = Maintained(spark.newSession(), path, "k")  # as after a crash, by the path alone
        assert state(found) == sorted(first)
    before = {r.batch: r.version for r in table.manifest().collect()}
    table.update(frame([(3, "new"), (3, "newer")]), keys(3, 4))
    expected = sorted([(k, "old") for k in range(50) if k not in (3, 4)] + [(3, "new"), (3, "newer")])
    assert state(table) == expected
    after = {r.batch: r.version for r in table.manifest().collect()}
    touched = {r.b for r in keys(3, 4).select(table.batch().alias("b")).collect()}
    assert {b for b in after if after[b] != before[b]} == touched  # other batches' files stay
    assert table.clean() > 0 and state(Maintained(spark, path, "k")) == expected and table.clean() == 0
    with pytest.raises(ValueError, match="not said"):
        table.update(frame([(9, "x")]), keys(8))
    table.update(frame([]), keys(*range(50)))
    assert state(table) == [] and table.manifest().count() == 0


def test_labels_gained_and_lost(spark):
    rows = spark.createDataFrame([(1, "a", 10), (1, "a", 11), (1, "b", 5), (2, "a", 7), (3, "c", 1)], "k int, label string, m int")
    gained = spark.createDataFrame([(1, "a", "n"), (2, "a", "b"), (2, "x", "n"), (1, "a", "b")], "k int, source string, label string")
    lost = spark.createDataFrame([(1, "a"), (3, "c"), (9, "a")], "k int, label string")
    assert sorted(tuple(r) for r in relabelled(rows, "label", gained, lost, "k").collect()) == [(1, "b", 5), (1, "n", 10), (1, "n", 11), (2, "a", 7), (2, "b", 7)]
