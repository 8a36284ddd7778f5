"""Benchmark decontamination by winnowing (operator 4).

Of the 5-word hashes in each 13-word window the least is kept; any span of 13 equal
words keeps the same one on both sides, so no shared window is missed. Test windows and
document windows meet on that fingerprint, and a meeting is extended to the window: its
own hash, then its words. An item of fewer than 13 words is one window, whose
fingerprint is the hash of all its words.

A bitmap of fixed size with the test fingerprints, and one with the test windows' hashes,
spare the join what can't meet; all that passes is joined with the test windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PART, Scratch, bitmap, in_bitmap, without
from .text import ALNUM_FOLDED, chunks, grams, signed, sliding_min

WINDOW, GRAM = 13, 5
#: 2 MB each; a benchmark of millions of windows fills them and is then only slower.
_BITS = 24


def _fingerprints(h: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of the n-word window at each word."""
    return sliding_min(grams(h, GRAM), WINDOW - GRAM + 1) if n == WINDOW else grams(h, n)


def test_windows(benchmark: DataFrame) -> DataFrame:
    """(n, fp, win, words, item_id): the windows of each item."""

    def run(batches):
        for batch in batches:
            for w in chunks(batch[1], ALNUM_FOLDED):
                h, left, n = w.hashes(), w.left(), np.diff(w.first)
                for size in {min(int(x), WINDOW) for x in n if x}:
                    fp = _fingerprints(h, size)
                    fits = left[: len(fp)] >= size
                    if size < WINDOW:
                        fits &= np.isin(np.arange(len(fp)), w.first[:-1][n == size])
                    at = np.flatnonzero(fits)
                    doc = np.searchsorted(w.first, at, side="right") - 1
                    yield pa.RecordBatch.from_pydict({
                        "n": pa.array(np.full(len(at), size, np.int32)), "fp": pa.array(signed(fp[at])), "win": pa.array(signed(grams(h, size, second=True)[at])),
                        "words": pa.array([w.text(i, i + size).decode("utf-8", "replace") for i in at.tolist()], pa.string()), "item_id": batch[0].take(pa.array(w.rows.start + doc)),
                    })

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"n int, fp long, win long, words string, item_id {kind}")


def _candidates(docs: DataFrame, sizes: list[int], fps, wins) -> DataFrame:
    """Each row with its number of words and the windows that may be test windows."""

    def run(batches):
        for batch in batches:
            words, lists = np.zeros(len(batch), dtype=np.int64), []
            row, pos, size, fp, win, text = [], [], [], [], [], []
            for w in chunks(batch[2], ALNUM_FOLDED):
                words[w.rows.start : w.rows.stop] = np.diff(w.first)
                h, left = w.hashes(), w.left()
                for n in sizes:
                    f = _fingerprints(h, n)
                    at = np.flatnonzero((left[: len(f)] >= n) & in_bitmap(fps.value, f))
                    second = grams(h, n, second=True)[at] if len(at) else f[:0]
                    keep = in_bitmap(wins.value, second)
                    at, second = at[keep], second[keep]
                    doc = np.searchsorted(w.first, at, side="right") - 1
                    row.append(doc + w.rows.start)
                    pos.append(at - w.first[doc])
                    size.append(np.full(len(at), n))
                    fp.append(f[at])
                    win.append(second)
                    text += [w.text(i, i + n).decode("utf-8", "replace") for i in at.tolist()]
            row = np.concatenate(row) if row else np.empty(0, np.int64)
            order = np.argsort(row, kind="stable")
            at = lambda x, kind: np.concatenate(x)[order].astype(kind) if x else np.empty(0, kind)
            lists = pa.StructArray.from_arrays(
                [pa.array(at(pos, np.int32)), pa.array(at(size, np.int32)), pa.array(signed(at(fp, np.uint64))), pa.array(signed(at(win, np.uint64))), pa.array(text, pa.string()).take(pa.array(order))],
                names=["pos", "n", "fp", "win", "words"],
            )
            offsets = np.searchsorted(row[order], np.arange(len(batch) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"doc_id": batch[0], "part": batch[1], "n_words": pa.array(words), "met": pa.ListArray.from_arrays(pa.array(offsets), lists)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    met = "array<struct<pos:int,n:int,fp:long,win:long,words:string>>"
    return docs.select("doc_id", F.expr(PART).alias("part"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, part int, n_words long, met {met}")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, part; a row for each row of ``docs``.

    Null and empty texts have no words and are clean; so are all documents if no item has
    words. Items with one id count once, items without an id are not listed though their
    windows hit. Repeated rows each give a row; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    tests = scratch.save(test_windows(benchmark), "tests")
    sizes = sorted(r.n for r in tests.select("n").distinct().collect())  # 13 values at most
    fps, wins = bitmap(spark, tests, "fp", _BITS), bitmap(spark, tests, "win", _BITS)
    rows = scratch.save(_candidates(docs, sizes, fps, wins).withColumn("row", F.monotonically_increasing_id()), "candidates")

    key = ["n", "fp", "win", "words"]
    met = rows.filter(F.size("met") > 0).select("row", F.explode("met").alias("m")).select("row", "m.*")
    hits = scratch.save(met.join(tests.select(*key).distinct(), key), "hits")
    cover = F.aggregate(
        F.array_sort(F.collect_set(F.struct("pos", "n"))),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit")),
        lambda s, x: F.struct(F.greatest(s["end"], x["pos"] + x["n"]).alias("end"), (s["hit"] + F.greatest(F.lit(0), x["pos"] + x["n"] - F.greatest(s["end"], x["pos"]))).alias("hit")),
        lambda s: s["hit"],
    )
    covered = hits.groupBy("row").agg(cover.alias("n_hit"))
    items = hits.select("row", *key).distinct().join(tests, key).select("row", F.col("item_id").cast("string").alias("item")).filter("item is not null").distinct()
    items = items.groupBy("row").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    out = rows.drop("met").join(covered.join(items, "row", "left"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "part",
    )


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("part")


OP4_SQL = r"""
with doc as (
  select doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), item as (
  select item_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), test as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as words
  from (select item_id, w, least(len(w), 13) as n, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) as i from item where len(w) > 0)
), size as (
  select distinct n from test
), hit as (
  select doc_id, i, n, words
  from (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as words from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from doc, size where len(w) >= n))
  where words in (select words from test)
), covered as (
  select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(generate_series(i, i + n - 1)) as at from hit) group by doc_id
), listed as (
  select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
  from (select distinct hit.doc_id, cast(test.item_id as varchar) as item from hit join test on hit.words = test.words and hit.n = test.n) group by doc_id
)
select doc.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join covered using (doc_id) left join listed using (doc_id)
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    scratch = Scratch(spark, "decontaminate-stage")
    bad = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated").select(F.col("doc_id").cast("long").alias("doc_id"), "part")
    return without(docs, scratch.save(bad, "bad"))
