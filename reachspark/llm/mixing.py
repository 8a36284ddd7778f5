"""Mixing sources to target weights by Pfair scheduling (operator 2), in DataFrame functions only.

Every source is cut into blocks of documents. A cycle has w blocks of a source of integer
weight w; with K blocks in a cycle, block i of a source with k blocks in it is released
at slot floor(i K / k) and due by ceil((i + 1) K / k). Earliest deadline first, one block
a slot, meets all these windows, so a source is never a whole block away from its share
of what has been dealt.

Cycles of the same composition have the same pattern, and a composition changes only
where a source runs out: its last cycle is a shorter one, after which the others go on
at their own weights. So the schedule of any number of blocks is the pattern of at most
2 S + 1 compositions for S sources, and each document finds its slot by arithmetic.
Nothing is dropped or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

#: Documents in a block.
BLOCK = 16
#: Weight of the largest source; others have the square root of their size relative to it, 1 at least.
LARGEST = 32
#: Hexadecimal digits of the hash by which a source is dealt into groups for ranking.
DIGITS = 3
#: A pattern of up to so many rows (some 64 MB) is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _key(column: str) -> Column:
    """A source's name that isn't null: null and empty stay apart."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def tempered(counts: DataFrame) -> DataFrame:
    """Target weights by the square root of a source's size: (key, n) to (key, n, w)."""
    most = counts.agg(F.max("n")).first()[0]
    return counts.select("key", "n", F.greatest(F.lit(1), F.floor(LARGEST * F.sqrt(F.col("n") / F.lit(most)))).cast("long").alias("w"))


def schedule(weighted: DataFrame, block: int = BLOCK) -> DataFrame:
    """The pattern: (key, w, i, first, last, start, size, slot).

    Block b of the source is number i = b mod w of cycle j = b div w; with first <= j <
    last its slot is start + (j - first) * size + slot. Sources are held in one array,
    which their number bounds. S sources take some LARGEST * S**2 steps for each of their
    2 S + 1 compositions, which are dealt out to as many tasks.
    """
    sources = weighted.count()
    blocks = F.ceil(F.col("n") / block).cast("long")
    one = weighted.agg(F.array_sort(F.collect_list(F.struct("key", "w", blocks.alias("blocks")))).alias("src"))
    whole = lambda s: F.floor(s["blocks"] / s["w"]).cast("long")
    points = F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), F.transform("src", whole), F.transform("src", lambda s: whole(s) + 1)))
    one = one.filter(F.size("src") > 0).withColumn("points", F.array_sort(points))
    parts = one.select("src", "points", F.posexplode("points").alias("at", "first")).withColumn("last", F.expr("try_element_at(points, at + 2)"))
    parts = parts.withColumn("k", F.transform("src", lambda s: F.greatest(F.lit(0), F.least(s["w"], s["blocks"] - F.col("first") * s["w"]))))
    add = lambda column: F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + x)
    parts = parts.withColumn("size", add(F.col("k"))).filter("size > 0")
    parts = parts.withColumn("start", add(F.transform("src", lambda s: F.least(s["blocks"], F.col("first") * s["w"]))))
    # one slot after the other: of the released blocks that with the earliest deadline, ties by
    # name; deadline and source are one number, deadline * sources + source
    picked = F.expr("""
        aggregate(sequence(0L, size - 1L), struct(transform(k, x -> 0L) as dealt, cast(array() as array<int>) as order),
          (s, t) -> transform(array(cast(array_min(transform(k, (x, i) -> if(x > s.dealt[i] and s.dealt[i] * size div x <= t, (((s.dealt[i] + 1) * size + x - 1) div x) * size(k) + i, null))) % size(k) as int)),
            p -> struct(transform(s.dealt, (x, i) -> if(i = p, x + 1L, x)) as dealt, concat(s.order, array(p)) as order))[0],
          s -> s.order)
    """)
    # compositions are independent of each other: a task for each
    parts = parts.repartition(max(1, 2 * sources + 1), "first")
    # outer, though no order is empty: else a filter is inferred that works the order out once more
    slots = parts.withColumn("order", picked).select("src", "first", "last", "size", "start", F.posexplode_outer("order").alias("slot", "s"))
    rank = F.row_number().over(W.partitionBy("first", "s").orderBy("slot")) - 1
    return slots.withColumn("i", rank.cast("long")).select(F.expr("src[s].key").alias("key"), F.expr("src[s].w").alias("w"), "i", "first", F.coalesce("last", F.lit((1 << 62))).alias("last"), "start", "size", F.col("slot").cast("long").alias("slot"))


def mixed(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """``docs`` with mix_block, mix_slot and mix_position, by which the mixture is in order.

    ``weights``: (source, w) with integer weights of 1 or more, anything else is an error; a
    source that it names several times has the sum, one that it doesn't name weight 1.
    Without it sources are tempered by size. The order within a source
    is that of MD5 of doc_id; null ids come as the empty text; rows with one id follow
    each other in any order; a null source is a source; an empty table gives no rows. Other
    columns stay, whatever their names; earlier mix_ columns are replaced.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    docs = docs.drop("mix_block", "mix_slot", "mix_position")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(F.struct("*").alias("whole"), "doc_id", "source").withColumn("mix_key", _key("source")).withColumn("mix_md5", digest).withColumn("mix_group", F.substring("mix_md5", 1, DIGITS))
    groups = scratch.save(rows.groupBy("mix_key", "mix_group").agg(F.count("*").alias("n")), "groups")
    before = groups.withColumn("before", F.sum("n").over(W.partitionBy("mix_key").orderBy("mix_group").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select(F.col("mix_key").alias("g_key"), F.col("mix_group").alias("g_group"), F.coalesce("before", F.lit(0)).alias("before"))
    counts = groups.groupBy(F.col("mix_key").alias("key")).agg(F.sum("n").alias("n"))
    if weights is None:
        weighted = tempered(counts)
    else:
        if not weights.filter("w is null or w < 1 or w != floor(w)").isEmpty():
            raise ValueError("weights must be integers of 1 or more")
        named = weights.groupBy(_key("source").alias("key")).agg(F.sum(F.col("w").cast("long")).alias("w"))
        weighted = counts.join(named, "key", "left").select("key", "n", F.coalesce("w", F.lit(1)).alias("w"))
    pattern = scratch.save(schedule(weighted, block), "pattern")
    near = F.broadcast if pattern.count() <= BROADCAST_ROWS else (lambda x: x)

    ranked = rows.withColumn("mix_rank", F.row_number().over(W.partitionBy("mix_key", "mix_group").orderBy("mix_md5", "doc_id")))
    starts = scratch.save(before, "before")
    ranked = ranked.join(F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts, (F.col("mix_key") == F.col("g_key")) & (F.col("mix_group") == F.col("g_group")))
    ranked = ranked.withColumn("mix_rank", F.col("before") + F.col("mix_rank") - 1).withColumn("mix_block", F.expr(f"mix_rank div {block}"))
    w = near(pattern.select(F.col("key").alias("w_key"), F.col("w").alias("w_w")).distinct())
    ranked = ranked.join(w, F.col("mix_key") == F.col("w_key")).withColumn("mix_i", F.expr("mix_block % w_w")).withColumn("mix_cycle", F.expr("mix_block div w_w"))
    found = ranked.join(near(pattern), (F.col("mix_key") == F.col("key")) & (F.col("mix_i") == F.col("i")) & (F.col("mix_cycle") >= F.col("first")) & (F.col("mix_cycle") < F.col("last")))
    slot = F.col("start") + (F.col("mix_cycle") - F.col("first")) * F.col("size") + F.col("slot")
    return found.withColumn("mix_slot", slot).withColumn("mix_position", F.col("mix_slot") * block + F.col("mix_rank") % block).select("whole.*", "mix_block", "mix_slot", "mix_position")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mixed(docs)


OP2_SQL = f"""
with recursive src as (
  select coalesce('=' || source, '') as key, count(*) as n from documents group by 1
), weighted as (
  select key, cast(ceil(n / {BLOCK}) as bigint) as blocks, greatest(1, cast(floor({LARGEST} * sqrt(n / max(n) over ())) as bigint)) as w, row_number() over (order by key) as s from src
), point as (
  select distinct unnest([0, blocks // w, blocks // w + 1]) as first from weighted
), part as (
  select first, list(greatest(0, least(w, blocks - first * w)) order by s) as k, sum(greatest(0, least(w, blocks - first * w))) as size, sum(least(blocks, first * w)) as start
  from point, weighted group by first
), bounded as (
  select first, lead(first, 1, 4611686018427387904) over (order by first) as last, k, cast(size as bigint) as size, cast(start as bigint) as start from part
), sim as (
  select first, k, size, cast(-1 as bigint) as slot, list_transform(k, lambda x: cast(0 as bigint)) as dealt, cast(0 as bigint) as s from bounded where size > 0
  union all
  select first, k, size, slot + 1, list_transform(dealt, lambda x, i: case when i = p then x + 1 else x end), p
  from (
    select *, list_min(list_filter(list_transform(k, lambda x, i: case when x > dealt[i] and dealt[i] * size // x <= slot + 1 then ((dealt[i] + 1) * size + x - 1) // x * 1000000 + i end), lambda y: y is not null)) % 1000000 as p
    from sim where slot + 1 < size
  )
), pattern as (
  select first, s, slot, row_number() over (partition by first, s order by slot) - 1 as i from sim where slot >= 0
), ranked as (
  select doc_id, source, key, s, w, r // {BLOCK} as block, r % {BLOCK} as r
  from (select doc_id, source, coalesce('=' || source, '') as key, row_number() over (partition by source order by md5(coalesce(cast(doc_id as varchar), '')), doc_id) - 1 as r from documents)
  join weighted using (key)
)
select doc_id, source, cast(block as bigint) as mix_block, cast(start + (block // w - bounded.first) * size + slot as bigint) as mix_slot,
  cast((start + (block // w - bounded.first) * size + slot) * {BLOCK} + r as bigint) as mix_position
from ranked join bounded on block // w >= bounded.first and block // w < bounded.last
join pattern on pattern.first = bounded.first and pattern.s = ranked.s and pattern.i = block % w
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: files by ranges of it, sorted within."""
    return mixed(docs).repartitionByRange("mix_position").sortWithinPartitions("mix_position")
