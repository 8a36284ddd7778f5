"""Results as arrays in tiles of bounded size, and back again with every check.

A tile is ``size`` consecutive cells, numbered from 0; a payload is one row a tile. Lists of
different length lie one after the other in flat arrays, with offsets ``o``: those of the
tile's i-th cell are at ``o[i] .. o[i + 1]``. What only few entries have is a sparse pair of
arrays, positions ``k`` and values. No row holds more than a tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Formats that can be read: 2 has "public transport, or walking where that is quicker".
FORMATS = (1, 2)


# -- lists of cells ----------------------------------------------------------------------


def encode(rows: DataFrame, cells: DataFrame, by: list[str], size: int, order: list[str], dense: list[str], sparse: str | None = None, empty: bool = True) -> DataFrame:
    """(by, tile, n, o, d ..., k, v): the lists of every cell of every tile, for each ``by``.

    ``rows`` has ``by``, ``cell`` (its number), ``order`` (of a list; no two rows of a cell
    are equal in it) and the columns ``dense``, an array each; where it has ``tile`` and is
    dealt out by it, it moves no more. ``cells`` has a row for each number; cells without
    rows have empty lists. With ``sparse``, a column of structs (value): entries where it is
    not null are listed as k, v; the value may be null. Tiles without rows are left out
    unless ``empty``, for which ``rows`` are read twice.
    """
    tile = F.floor(F.col("cell") / size).cast("long")
    count = cells.groupBy(tile.alias("tile")).agg((F.max("cell") % size + 1).cast("int").alias("n"))
    fields = list(dict.fromkeys([*order, *dense]))
    entry = F.struct((F.col("cell") % size).cast("int").alias("at"), *[F.col(c).alias(f"_{c}") for c in fields], *([F.col(sparse).isNotNull().alias("marked"), F.col(sparse)["value"].alias("value")] if sparse else []))
    parts = rows.select(*by, (F.col("tile") if "tile" in rows.columns else tile).alias("tile"), entry.alias("_e"))
    flat = F.collect_list("_e")
    if any(t in parts.schema["_e"].dataType.simpleString() for t in ("map<", "variant", "interval")):  # may have no order
        flat = F.array_sort(flat, _by_order(["at", *[f"_{c}" for c in order]]))
    else:
        flat = F.sort_array(flat)
    if empty:
        spine = count.join(rows.select(*by).distinct()) if by else count  # keys are settings (modes, services), tiles a few thousandths of the cells
        # the spine's rows lie among the entries, so that these are neither joined nor sorted again; they move as rows, before lists are made of them
        parts = parts.withColumn("n", F.lit(None).cast("int")).unionByName(spine.select(*by, "tile", F.lit(None).cast(parts.schema["_e"].dataType).alias("_e"), "n"))
        tiles = parts.repartition("tile", *by).groupBy("tile", *by).agg(flat.alias("_flat"), F.max("n").alias("n")).filter("n is not null")
    else:
        tiles = (parts if "tile" in rows.columns else parts.repartition("tile")).groupBy("tile", *by).agg(flat.alias("_flat")).join(count, "tile")
    # the first entry of each cell that has one: there begin the lists of this cell and of those without rows before it; what is beyond all entries begins at their end
    at = F.col("_flat")["at"]
    # (no function of an entry names the array itself: it would be taken out of the list again for each)
    pairs = F.arrays_zip(F.col("_at").alias("a"), F.concat(F.array(F.lit(-1)), F.col("_at")).alias("before"))
    firsts = F.filter(F.transform(pairs, lambda x, j: F.when(x["a"] > x["before"], F.struct(x["a"].alias("a"), j.alias("j")))), lambda x: x.isNotNull())
    begun = F.aggregate(firsts, F.array().cast("array<int>"), lambda o, x: F.concat(o, F.array_repeat(x["j"], x["a"] + 1 - F.size(o))))
    offsets = F.slice(F.concat(begun, F.array_repeat(F.size("_at"), F.col("n") - F.coalesce(F.array_max("_at"), F.lit(-1)))), 1, F.col("n") + 1)
    out = [*by, "tile", "n", offsets.alias("o"), *[F.col("_flat")[f"_{c}"].alias(c) for c in dense]]
    tiles = tiles.withColumn("_at", at)
    if sparse:
        tiles = tiles.withColumn("_k", F.filter(F.transform(F.col("_flat")["marked"], lambda m, i: F.when(m, i)), lambda i: i.isNotNull()))
        out += [F.col("_k").alias("k"), F.transform("_k", lambda i: F.col("_flat")[i]["value"]).alias("v")]
    return tiles.select(*out)


def _by_order(order: list[str]):
    """A comparator by the named fields only, so that other fields may be of any type."""

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for c in reversed(order):
            out = F.when(a[c] < b[c], -1).when(a[c] > b[c], 1).otherwise(out)
        return out

    return compare


def problem(form: str, n: str, o: str, d: str, m: str, k: str | None = None, v: str | None = None) -> Column:
    """What is wrong with a payload, null if nothing is; the named columns are its format and arrays.

    Offsets may leave out the last one, which then is the length. They begin at 0, never go
    down and end at the length. A null array is damage too.
    """
    ends = F.when(F.size(o) == F.col(n), F.concat(F.col(o), F.array(F.size(d)))).otherwise(F.col(o))
    falls = F.exists(F.zip_with(F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))), F.slice(ends, 2, F.greatest(F.size(ends) - 1, F.lit(0))), lambda a, b: F.coalesce(a > b, F.lit(True))), lambda x: x)
    found = (
        F.when(~F.coalesce(F.col(form).isin(*FORMATS), F.lit(False)) | F.col(o).isNull() | F.col(d).isNull() | F.col(m).isNull(), "format")
        .when(F.size(d) != F.size(m), "more entries than values").when(~F.size(o).isin(F.col(n), F.col(n) + 1), "number of offsets")
        .when(falls, "order of offsets").when((F.element_at(ends, 1) != 0) | (F.element_at(ends, -1) != F.size(d)), "cover of offsets")
    )
    if k:
        both = F.col(k).isNotNull() & F.col(v).isNotNull()
        found = found.when(both & (F.size(k) != F.size(v)), "more positions than values").when(both & F.exists(k, lambda x: x.isNull() | (x < 0) | (x >= F.size(d))), "position out of range")
    return found


def decode(payloads: DataFrame, by: list[str], size: int, dense: list[str], sparse: bool = False, form: str = "format") -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of payloads with format, n, o, and the arrays ``dense``, the first two of which must be as long as each other.

    rows: (by, cell, place, values; with ``sparse`` also marked and value): entries in the
    order of their list; an array beyond the first two counts only if it is as long, else
    its values are null. problems: (by, tile, problem): payloads that can't be read, of
    which no row is given.
    """
    d, m, *more = dense
    checked = payloads.withColumn("problem", problem(form, "n", "o", d, m, *(["k", "v"] if sparse else [])))
    # rows are told by what is exploded: a filter would be moved below what it reads, and have every array made again for each mention
    bad = checked.select(*by, "tile", F.explode(F.when(F.col("problem").isNotNull(), F.array("problem"))).alias("problem"))
    whole = F.col("problem").isNull() & (F.col("n") > 0)
    end = lambda i: F.when(i + 1 < F.size("o"), F.get("o", i + 1)).otherwise(F.size(d))
    # for each entry its cell and where that one's list begins
    owners = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.array_repeat(F.struct((F.col("tile") * size + i).alias("cell"), F.get("o", i).alias("first")), end(i) - F.get("o", i)))
    fitting = [F.when(F.size(c) == F.size(d), F.col(c)).otherwise(F.array().cast(payloads.schema[c].dataType)).alias(c) for c in more]
    tiles = checked.select(*by, d, m, *fitting, F.when(whole, F.flatten(owners)).alias("_own"), *(["k", "v"] if sparse else []))
    arrays, out = [d, m, *more, "_own"], [*by, F.col("_e._own.cell").alias("cell"), (F.col("_at") - F.col("_e._own.first")).alias("place"), *[F.col(f"_e.{c}").alias(c) for c in dense]]
    if sparse:
        tiles = _laid_out(tiles, F.col("_own").isNotNull(), "k", "v", "_mark")
        arrays.append("_mark")
        out += [F.col("_e._mark").isNotNull().alias("marked"), F.col("_e._mark.value").alias("value")]
    entries = tiles.select(*by, F.posexplode(F.when(F.col("_own").isNotNull(), F.arrays_zip(*arrays))).alias("_at", "_e"))
    return entries.select(*out), bad


def _laid_out(tiles: DataFrame, where: Column, k: str, v: str, name: str) -> DataFrame:
    """Adds ``name``: structs of the values ``v`` at their positions ``k``, nulls between them; of a position that is named twice the first counts."""
    pairs = F.sort_array(F.transform(k, lambda p, i: F.struct(p.cast("int").alias("p"), i.alias("i"))))
    tiles = tiles.withColumn("_s", F.when(where & F.col(k).isNotNull() & F.col(v).isNotNull(), pairs))
    before = lambda i: F.get("_s", i - 1)["p"]
    tiles = tiles.withColumn("_s", F.filter("_s", lambda x, i: before(i).isNull() | (before(i) != x["p"])))
    value = lambda x: F.struct(F.get(v, x["i"]).alias("value"))
    none = T.ArrayType(T.StructType([T.StructField("value", tiles.schema[v].dataType.elementType)]))
    gap = lambda x, i: F.array_repeat(F.lit(None).cast(none.elementType), x["p"] - F.coalesce(before(i), F.lit(-1)) - 1)
    laid = F.flatten(F.transform("_s", lambda x, i: F.concat(gap(x, i), F.array(value(x)))))
    return tiles.withColumn(name, F.coalesce(laid, F.array().cast(none))).drop("_s")


def weights(values: Column) -> Column:
    """Weights between 0 and 1; what is no finite number is 0."""
    return F.transform(values, lambda w: F.when(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), w))))


# -- columns of cells ----------------------------------------------------------------------


def columns(table: DataFrame, size: int, groups: dict[str, list[str]], digits: dict[str, int]) -> DataFrame:
    """(tile, grp, name, n, dense, k, v): a row for each column and tile of ``table``, which has a number ``cell`` and numeric columns.

    ``groups`` says which columns are sent first and which later. Values are rounded half to
    even to ``digits`` (0 if not named); what is no finite number is null. A column that has
    values for less than a quarter of a tile's cells is sparse (k: places in the tile, v),
    else dense, an array with nulls.
    """
    names = [(g, c) for g, cs in groups.items() for c in cs]
    rounded = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.bround(c, digits.get(c, 0)))
    one = table.select(F.floor(F.col("cell") / size).cast("long").alias("tile"), (F.col("cell") % size).cast("int").alias("place"), *[rounded(c).cast("double").alias(c) for _, c in names] if names else [])
    packed = one.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("place", *[c for _, c in names]))).alias("_r"))
    values = lambda c: F.transform("_r", lambda r: F.struct(r["place"].alias("place"), r[c].alias("value")))
    blocks = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(c).alias("name"), values(c).alias("_v")) for g, c in names])
    rows = packed.select("tile", F.explode(blocks).alias("_b")).select("tile", "_b.grp", "_b.name", "_b._v")
    n = F.array_max(F.transform("_v", lambda x: x["place"])) + 1
    held = F.filter("_v", lambda x: x["value"].isNotNull())
    rows = rows.select("tile", "grp", "name", n.alias("n"), held.alias("_h"))
    few = F.size("_h") * 4 < F.col("n")
    of = F.map_from_arrays(F.transform("_h", lambda x: x["place"]), F.transform("_h", lambda x: x["value"]))
    dense = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.try_element_at("_of", i))
    return rows.withColumn("_of", of).select("tile", "grp", "name", "n", F.when(~few, dense).alias("dense"), F.when(few, F.transform("_h", lambda x: x["place"])).alias("k"), F.when(few, F.transform("_h", lambda x: x["value"])).alias("v"))


def cells_of(payload: DataFrame, size: int, names: list[str]) -> DataFrame:
    """The table again: (cell, the named columns), null where a column has nothing. Cells in which every column is null are left out."""
    dense = F.transform("dense", lambda x, i: F.struct(i.alias("place"), x.alias("value")))
    some = F.zip_with("k", "v", lambda k, v: F.struct(k.alias("place"), v.alias("value")))
    rows = payload.filter(F.col("name").isin(names)).select("tile", "name", F.explode(F.when(F.col("dense").isNotNull(), dense).otherwise(some)).alias("_e")).filter("_e.value is not null")
    rows = rows.select((F.col("tile") * size + F.col("_e.place")).alias("cell"), "name", F.col("_e.value").alias("value"))
    return rows.groupBy("cell").pivot("name", names).agg(F.max("value"))
