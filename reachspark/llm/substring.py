"""Substring deduplication with a log-structured fingerprint index (operator 7).

A window is 13 consecutive words. Of the 5-word hashes in a window the least is its
*fingerprint*; consecutive windows with one fingerprint are a *segment*, about one for
five words. Equal windows have equal fingerprints, so a fingerprint that occurs in one
document only needs no further look.

``FingerprintIndex`` keeps what it has seen as immutable runs: tables bucketed and sorted
by fingerprint, with a row for each different segment: its fingerprint, a hash of all its
words, and the first document that has it. ``ingest`` writes a batch as a new run and
merge-joins it with the older ones bucket by bucket, without a shuffle:

* where all segments of a fingerprint are equal, in the new run and the old ones, the
  run itself verifies all their windows, by 128 bits over the words themselves;
* where they differ (at a passage's ends) single windows are compared, again by 128 bits.
  The windows of older batches are made from the first documents of such segments only;
  no other old text is looked at again.

When there are too many runs, they are compacted into one.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PART, Scratch, bitmap, in_bitmap
from .text import SPACED, chunks, grams, signed, sliding_min
from .text import _second_hash as any_length

WINDOW, GRAM = 13, 5
#: Stands for every document of earlier batches: it precedes all of this batch.
_EARLIER = -(1 << 63)
#: Spans up to this many bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def _windows(w):
    """Word hashes, fingerprint of the window at each word, and whether a window starts there."""
    h = w.hashes()
    least = sliding_min(grams(h, GRAM), WINDOW - GRAM + 1)
    return h, least, w.left()[: len(least)] >= WINDOW


def _segments(w):
    """Of each segment: its hash, first word, windows, fingerprint and document."""
    h, least, ok = _windows(w)
    at = np.flatnonzero(ok)
    if not len(at):
        return None
    doc, fp = w.doc()[at], least[at]
    new = np.flatnonzero(np.r_[True, (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])])
    n = np.diff(np.r_[new, len(at)])
    return h, fp[new], at[new], n, doc[new]


def _whole(h, at, n):
    """A hash of all words of each segment."""
    return any_length(h, at, at + n + WINDOW - 1) if len(h) < (1 << 22) else _piecewise(h, at, at + n + WINDOW - 1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(h, seg, low, high): each segment once for some MB of text, with the least and greatest document that have it there.

    A passage that most documents have is therefore a few rows for each of these pieces,
    however many documents they are.
    """

    def run(batches):
        for batch in batches:
            ids = batch[0].to_numpy(zero_copy_only=False)
            for w in chunks(batch[1], SPACED):
                if (found := _segments(w)) is None:
                    continue
                h, fp, at, n, doc = found
                seg, owner = _whole(h, at, n), ids[w.rows.start + doc]
                order = np.lexsort((owner, seg, fp))
                fp, seg, owner = fp[order], seg[order], owner[order]
                new = np.flatnonzero(np.r_[True, (fp[1:] != fp[:-1]) | (seg[1:] != seg[:-1])])
                yield pa.RecordBatch.from_pydict({"h": pa.array(signed(fp[new])), "seg": pa.array(signed(seg[new])), "low": pa.array(owner[new]), "high": pa.array(owner[np.r_[new[1:], len(fp)] - 1])})

    return docs.select("doc_id", "text").mapInArrow(run, "h long, seg long, low long, high long")


def _segment_rows(docs: DataFrame, bits) -> DataFrame:
    """(h, doc_id, part, pos, n) of the segments whose fingerprint is in the bitmap."""

    def run(batches):
        for batch in batches:
            ids, keys = batch[0].to_numpy(zero_copy_only=False), batch[1].to_numpy(zero_copy_only=False)
            for w in chunks(batch[2], SPACED):
                if (found := _segments(w)) is None:
                    continue
                _, fp, at, n, doc = found
                keep = in_bitmap(bits.value, fp)
                if not keep.any():
                    continue
                fp, at, n, doc = fp[keep], at[keep], n[keep], doc[keep]
                row = w.rows.start + doc
                yield pa.RecordBatch.from_pydict({"h": pa.array(signed(fp)), "doc_id": pa.array(ids[row]), "part": pa.array(keys[row]), "pos": pa.array((at - w.first[doc]).astype(np.int32)), "n": pa.array(n.astype(np.int32))})

    return docs.select("doc_id", "part", "text").mapInArrow(run, "h long, doc_id long, part int, pos int, n int")


def _piecewise(h, starts, ends):
    """The same hashes for a very long text, without tables of its whole length."""
    return np.concatenate([any_length(h[a : b], np.zeros(1, np.int64), np.array([b - a])) for a, b in zip(starts, ends, strict=True)])


def _window_rows(docs: DataFrame, bits, only=None) -> DataFrame:
    """(h, win, doc_id, part, pos) of the windows whose fingerprint is in the bitmap; with ``only``, of documents whose id is in that one."""

    def run(batches):
        for batch in batches:
            if only is not None:
                wanted = in_bitmap(only.value, batch[0].to_numpy(zero_copy_only=False).view(np.uint64))
                batch = batch.filter(pa.array(wanted))
            ids, keys = batch[0].to_numpy(zero_copy_only=False), batch[1].to_numpy(zero_copy_only=False)
            for w in chunks(batch[2], SPACED):
                h, least, ok = _windows(w)
                at = np.flatnonzero(ok)
                at = at[in_bitmap(bits.value, least[at])]
                if not len(at):
                    continue
                doc = np.searchsorted(w.first, at, side="right") - 1
                row = w.rows.start + doc
                yield pa.RecordBatch.from_pydict({"h": pa.array(signed(least[at])), "win": pa.array(signed(grams(h, WINDOW, second=True)[at])), "doc_id": pa.array(ids[row]), "part": pa.array(keys[row]), "pos": pa.array((at - w.first[doc]).astype(np.int32))})

    return docs.select("doc_id", "part", "text").mapInArrow(run, "h long, win long, doc_id long, part int, pos int")


def _joined_up(cover):
    """Covered words as first, end, first, end ..., from sorted (pos, end) of what covers them."""
    whole = lambda s: F.concat(s["done"], F.when(s["end"] > 0, F.array(s["pos"], s["end"])).otherwise(F.array().cast("array<int>")))
    none = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("pos"), F.lit(0).alias("end"))
    step = lambda s, x: F.when(x["pos"] <= s["end"], F.struct(s["done"], s["pos"], F.greatest(s["end"], x["end"]).alias("end"))).otherwise(F.struct(whole(s).alias("done"), x["pos"].alias("pos"), x["end"].alias("end")))
    return F.aggregate(cover, none, step, whole)


def _with_part(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(PART).alias("part"), F.col("text").cast("string").alias("text"))


class FingerprintIndex:
    """Sorted runs of fingerprints of all batches so far."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.scratch = Scratch(spark, "substring")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.texts: list[DataFrame] = []

    def _write_run(self, rows: DataFrame) -> str:
        name = f"fingerprints_{uuid.uuid4().hex[:12]}"
        rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.scratch.path}/{name}").saveAsTable(name)
        return name

    def _met(self, run: str) -> DataFrame:
        """(h, owner, differ): fingerprints of ``run`` that another document has too, and whether its segments differ.

        ``owner`` is the first document, _EARLIER if an older run has the fingerprint.
        """
        same, seen = F.col("low") == F.col("high"), F.lit(False)
        own = self.spark.table(run).groupBy("h").agg(F.min("seg").alias("low"), F.max("seg").alias("high"), F.min("owner").alias("owner"), F.max("last").alias("last"))
        for i, old in enumerate(self.runs):
            other = self.spark.table(old).groupBy("h").agg(F.min("seg").alias(f"low{i}"), F.max("seg").alias(f"high{i}"))
            own = own.join(other.hint("merge"), "h", "left")
            same = same & F.coalesce((F.col(f"low{i}") == F.col("low")) & (F.col(f"high{i}") == F.col("low")), F.lit(True))
            seen = seen | F.col(f"low{i}").isNotNull()
        met = own.select("h", F.when(seen, F.lit(_EARLIER)).otherwise(F.col("owner")).alias("owner"), (~same).alias("differ"), (seen | (F.col("owner") < F.col("last"))).alias("again"))
        return met.filter("again").drop("again")

    def _owners(self, ends) -> DataFrame:
        """First documents of the segments in the runs whose fingerprint is in the bitmap."""

        def run(batches):
            for batch in batches:
                wanted = in_bitmap(ends.value, batch[0].to_numpy(zero_copy_only=False).view(np.uint64))
                yield pa.RecordBatch.from_pydict({"owner": pa.array(np.unique(batch[1].to_numpy(zero_copy_only=False)[wanted]))})

        rows = None
        for name in self.runs:
            one = self.spark.table(name).select("h", "owner").mapInArrow(run, "owner long")
            rows = one if rows is None else rows.unionByName(one)
        return rows.distinct()

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Take in ``batch``; of its rows give (doc_id, part, spans) where words are covered by repeated windows.

        A window is repeated if it starts in a document of an earlier batch or in one of
        this batch with a smaller doc_id. Rows with a null id are neither owners nor
        changed. The index keeps the batch's DataFrame, which must stay readable.
        """
        if len(self.runs) > self.fanout:
            self.compact()
        k = len(self.texts)
        batch = _with_part(batch).filter("doc_id is not null")
        dealt = fingerprints(batch).repartition(self.buckets, "h").groupBy("h", "seg").agg(F.min("low").alias("owner"), F.max("high").alias("last"))
        run = self._write_run(dealt)
        met = self.scratch.save(self._met(run), f"{k}-met")
        repeated = met.filter("not differ").select("h", "owner")
        bits, ends = bitmap(self.spark, repeated, "h"), bitmap(self.spark, met.filter("differ"), "h")
        covered = _segment_rows(batch, bits).join(repeated, "h").filter("doc_id > owner").select("doc_id", "part", "pos", "n")

        rows, only = _window_rows(batch, ends), None
        if self.runs:
            only = bitmap(self.spark, self._owners(ends), "owner")
            for texts in self.texts:
                rows = rows.unionByName(_window_rows(texts, ends, only).withColumn("doc_id", F.lit(_EARLIER)))
        rows = self.scratch.save(rows, f"{k}-windows")
        owners = rows.groupBy("h", "win").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner < last").drop("last")
        owners = self.scratch.save(owners, f"{k}-window-owners")  # so that both sides of the join are dealt out for it, and a frequent window can be split
        single = rows.filter(F.col("doc_id") > _EARLIER).join(owners, ["h", "win"]).filter("doc_id > owner").select("doc_id", "part", "pos", F.lit(1).alias("n"))

        cover = F.array_sort(F.collect_list(F.struct("pos", (F.col("pos") + F.col("n") + WINDOW - 1).alias("end"))))
        spans = covered.unionByName(single).groupBy("doc_id", "part").agg(cover.alias("cover")).select("doc_id", "part", _joined_up(F.col("cover")).alias("spans"))
        spans = self.scratch.save(spans, f"{k}-spans")
        for used in (bits, ends, only):
            if used is not None:
                used.destroy()
        self.scratch.drop(*[f"{k}-{t}" for t in ("met", "windows", "window-owners")])
        self.runs.append(run)
        self.texts.append(batch)
        return spans

    def compact(self) -> None:
        """One run in place of all, with the first document of each segment."""
        rows = None
        for name in self.runs:
            one = self.spark.table(name)
            rows = one if rows is None else rows.unionByName(one)
        # dealt out anew: a union of bucketed tables must not be taken to lie in their buckets
        merged = rows.repartition(self.buckets, "h").groupBy("h", "seg").agg(F.min("owner").alias("owner"), F.max("last").alias("last"))
        old, self.runs = self.runs, [self._write_run(merged)]
        self._delete(old)

    def _delete(self, runs: list[str]) -> None:
        for name in runs:
            self.spark.sql(f"drop table if exists {name}")
            self.scratch.drop(name)

    def close(self) -> None:
        """Delete the runs; spans that were given out stay."""
        self._delete(self.runs)
        self.runs = []


def _joined(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """whole (the row of ``docs``), doc_id, text, spans (null: none); a broadcast only if the spans are known to be small."""
    n, values = spans.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    spans = spans.select(F.col("doc_id").alias("span_id"), F.col("part").alias("span_part"), "spans")
    if 32 * n + 4 * values <= BROADCAST_BYTES:
        spans = F.broadcast(spans)
    rows = docs.select(F.struct("*").alias("whole"), F.col("doc_id").cast("long").alias("doc_id"), F.expr(PART).alias("part"), F.col("text").cast("string").alias("text"))
    return rows.join(spans, (F.col("doc_id") == F.col("span_id")) & (F.col("part") == F.col("span_part")), "left").select("whole", "doc_id", "text", "spans")


def _keep(w, i: int, spans) -> tuple[int, int, bytes]:
    a, b = int(w.first[i]), int(w.first[i + 1])
    if not spans:
        return b - a, 0, w.text(a, b)
    cut = np.asarray(spans, dtype=np.int64).reshape(-1, 2)
    left = [w.text(a + x, a + y) for x, y in zip([0, *cut[:, 1].tolist()], [*cut[:, 0].tolist(), b - a], strict=True) if y > x]
    return b - a, int((cut[:, 1] - cut[:, 0]).sum()), b" ".join(left)


def repeated_spans(docs: DataFrame, batches: int = 3, fanout: int = 1) -> DataFrame:
    """Spans of all documents, taken in as ``batches`` batches of ascending doc_id, with a compaction when there are over ``fanout`` runs."""
    spark = docs.sparkSession
    index = FingerprintIndex(spark, fanout=fanout)
    own = F.col("doc_id").cast("long")
    low, high, inner = docs.agg(F.min(own), F.max(own), F.percentile_approx(own, [k / batches for k in range(1, batches)] or [0.5])).first()
    # by quantiles, so that one far-off id makes no empty batches
    cuts = sorted({low, *[x + 1 for x in inner if batches > 1], high + 1}) if low is not None else [0, 1]
    spans = None
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            found = index.ingest(docs.filter(F.col("doc_id").cast("long").between(a, b - 1)))
            spans = found if spans is None else spans.unionByName(found)
    index.close()
    return spans


def drop_repeated(docs: DataFrame, batches: int = 3, digest: bool = False) -> DataFrame:
    """``docs`` without the words that 13-word windows of smaller documents cover.

    The columns of ``docs`` stay; a changed text is its kept words joined by one space, and
    n_chars, if there is one, its length.
    With ``digest``: doc_id, n_words, n_removed, kept_sha256 instead. Null texts have no
    words; rows with one id are judged against smaller ids only; a row with a null id is
    left as it is; an empty table gives no rows.
    """
    with_spans = _joined(docs, repeated_spans(docs, batches))

    if digest:

        def run(parts):
            for batch in parts:
                out = []
                for w in chunks(batch[1], SPACED):
                    for i in range(len(w.rows)):
                        n, removed, kept = _keep(w, i, batch[2][w.rows.start + i].as_py())
                        out.append((n, removed, hashlib.sha256(kept).hexdigest()))
                n, removed, sha = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_pydict({"doc_id": batch[0], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

        return with_spans.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")

    @F.pandas_udf("string")
    def kept(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, cut in zip(text, spans, strict=True):
            out.append(None if t is None else next(_keep(w, 0, cut.tolist())[2].decode() for w in chunks(pa.array([t], pa.string()), SPACED)))
        return pd.Series(out, dtype="object")

    changed = F.col("spans").isNotNull()
    # only changed texts are handed to Python
    out = with_spans.withColumn("text", F.coalesce(kept(F.when(changed, F.col("text")), "spans"), "text"))
    new = {"text": F.col("text"), "n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("whole.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[new.get(c, F.col(f"whole.`{c}`")).alias(c) for c in docs.columns])


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


OP7_SQL = r"""
with doc as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), win as (
  select r, doc_id, i, array_to_string(w[i:i + 12], ' ') as x from (select r, doc_id, w, unnest(generate_series(1, len(w) - 12)) as i from doc where len(w) >= 13 and doc_id is not null)
), owned as (
  select x, min(doc_id) as owner from win group by x
), gone as (
  select distinct r, unnest(generate_series(i, i + 12)) as i from win join owned using (x) where owner < doc_id
), word as (
  select r, unnest(w) as word, generate_subscripts(w, 1) as i from doc
), kept as (
  select r, count(*) filter (where gone.i is not null) as n_removed, string_agg(word, ' ' order by word.i) filter (where gone.i is null) as text from word left join gone using (r, i) group by r
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(text, '')) as kept_sha256 from doc left join kept using (r)
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from all but the first document that has them; every document stays."""
    return drop_repeated(docs)
