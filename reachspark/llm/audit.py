"""Audit of how filters interact, over every order of them (operator 11).

A row's failures are a bit mask over the filters, so rows that fail the same filters are
one *cell* of counts. What any set of active filters leaves follows from the cells alone.
``subset_states`` walks all sets in the order of a Gray code: each step switches one filter
on or off, moves the active-failure counter of the cells that fail it, and adds or takes
away only the cells whose counter reaches or leaves zero. The states are a table; what a
filter removes at a step of an order is the difference of two states.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SPACE = r"[\x20\x09-\x0D]+"
#: Orders are factorial in the filters: 8 have 322,560 steps a part.
MOST_FILTERS = 8
MEASURES = ("n", "good", "toxic")


def conditions() -> dict[str, Column]:
    """Failure conditions A to D on a column ``text`` (no null) and its ``words``."""
    distinct, words = F.size(F.array_distinct("words")), F.size("words")
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    return {"A": words < 100, "B": 100 * distinct < 80 * words, "C": 100 * capitals > 10 * F.length("text"), "D": F.col("text").rlike("[#$%&*|]")}


def failures(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, part, mask) of each row: bits of the filters A to E that it fails, A the lowest.

    E fails a text that a smaller doc_id has too. Texts are told apart by SHA-256; the
    first id of those that occur again is joined to them by digest, so a text that a third
    of all rows have is one row of a join that can be split.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(conditions().values())), F.lit(0))
    rows = scratch.save(rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "masks")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(first, "digest", "left").select("doc_id", "part", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"))


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows by part and failures, and those labelled quality 1 and toxic 1."""
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic")).filter("good + toxic > 0")
    count = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(c)
    return masks.join(labels, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), count("good"), count("toxic"))


def subset_states(cells: DataFrame, filters: int) -> DataFrame:
    """(part, state, n, good, toxic): what each of the 2**filters sets of active filters keeps of each part.

    A group is the cells of one part, at most 2**filters rows.
    """

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        masks, counts = group["mask"].to_numpy(), group[list(MEASURES)].to_numpy()
        failing = np.zeros(len(masks), dtype=np.int64)
        kept, state = counts.sum(axis=0), 0
        states = [(state, *kept)]
        for step in range(1, 1 << filters):
            bit = step & -step  # the one bit in which this Gray code differs from the one before
            fails = masks & bit != 0
            if state & bit:
                failing[fails] -= 1
                kept = kept + counts[fails & (failing == 0)].sum(axis=0)
            else:
                kept = kept - counts[fails & (failing == 0)].sum(axis=0)
                failing[fails] += 1
            state ^= bit
            states.append((state, *kept))
        out = pd.DataFrame(states, columns=["state", *MEASURES])
        out.insert(0, "part", group["part"].iloc[0])
        return out

    return cells.groupBy("part").applyInPandas(walk, "part string, state int, n long, good long, toxic long")


def orders(states: DataFrame, filters: str) -> DataFrame:
    """A row per part, order of the filters and step, as differences of states."""
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    every, bit = (1 << len(filters)) - 1, {f: 1 << k for k, f in enumerate(filters)}
    steps = []
    for order in permutations(filters):
        before = 0
        for k, f in enumerate(order):
            steps.append(("".join(order), k + 1, f, before, before | bit[f], bit[f], every ^ bit[f]))
            before |= bit[f]
    steps = states.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, before int, after int, alone int, others int")

    def state(at: str) -> DataFrame:
        return states.select("part", F.col("state").alias(at), F.struct(*MEASURES).alias(f"{at}_counts"))

    # all of these are 2**filters rows a part; the steps are a fixed table
    out = state("after").join(F.broadcast(steps), "after")
    for at in ("before", "alone", "others"):
        out = out.join(state(at), ["part", at])
    whole = lambda s: states.filter(F.col("state") == s).select("part", F.col("n").alias(f"n_{s}"))
    out = out.join(whole(0), "part").join(whole(every), "part")
    lost = lambda c: F.col(f"before_counts.{c}") - F.col(f"after_counts.{c}")
    out = out.select(
        "part", "filter_order", "step", "filter", F.col("after_counts.n").alias("kept"), lost("n").alias("removed"), (F.col("n_0") - F.col("alone_counts.n") - lost("n")).alias("redundant"),
        (F.col("others_counts.n") - F.col(f"n_{every}")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
    )
    shapley = out.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return out.join(shapley, ["part", "filter"]).drop("filter")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of the filters A to E removes at each step of all 120 orders, by ``lang``.

    Null text is empty, null lang the part "". A null doc_id is neither smaller nor larger
    than another, so filter E leaves it and its copies alone, and it has no label. Several
    labels of one id count if one of them is 1; repeated rows count each. An empty table has
    no parts and gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    found = scratch.save(cells(failures(docs, scratch), labels), "cells")
    scratch.drop("masks")
    states = scratch.save(subset_states(found, 5), "states")
    return orders(states, "ABCDE")


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
with doc as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), own as (
  select t, min(doc_id) as first from doc group by t
), lab as (
  select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id
), fact as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::int
      + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > first, false)::int as mask
  from doc join own using (t) left join lab using (doc_id)
), state as (
  select part, s, cast(count(*) filter (where mask & s = 0) as bigint) as n, cast(count(*) filter (where mask & s = 0 and good) as bigint) as good, cast(count(*) filter (where mask & s = 0 and toxic) as bigint) as toxic
  from fact, (select unnest(generate_series(0, 31)) as s) group by all
), f as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit
), ord as (
  select a.f || b.f || c.f || d.f || e.f as filter_order, unnest([1, 2, 3, 4, 5]) as step, unnest([a.f, b.f, c.f, d.f, e.f]) as f, unnest([a.bit, b.bit, c.bit, d.bit, e.bit]) as bit,
    unnest([0, a.bit, a.bit + b.bit, a.bit + b.bit + c.bit, 31 - e.bit]) as before
  from f a, f b, f c, f d, f e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31
), res as (
  select part, filter_order, step, f, y.n as kept, x.n - y.n as removed, z.n - o.n - (x.n - y.n) as redundant, u.n - v.n as unique_fails, x.good - y.good as good_lost, x.toxic - y.toxic as toxic_lost
  from ord join state x on x.s = before join state y using (part) join state z using (part) join state o using (part) join state u using (part) join state v using (part)
  where y.s = before + bit and z.s = 0 and o.s = bit and u.s = 31 - bit and v.s = 31
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley from res
"""
