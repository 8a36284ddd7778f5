"""Byte-level deduplication with a family of suffix arrays in levels (operator 12).

A match is a string of 200 bytes that starts at two places. Of the 32-byte hashes in such a
window the least is its *anchor* (the leftmost of equal ones), so equal windows have equal
anchors at equal distances. Consecutive windows with one anchor are a *segment*: about one
for 85 bytes, n windows in n + 199 bytes. Segments meet by the hash of their anchor, h:

* a segment that occurs twice as a whole is repeated throughout; segments are told apart by
  a 128-bit BLAKE2 digest of their bytes, and no array is needed for them;
* where one h has different segments (at the ends of a passage, around an edit), their
  suffixes are compared. ``SuffixLevels`` keeps these: a batch's segments get a suffix
  array for each bucket of h (windows in lexicographic order of all their 200 bytes), which
  is merge-scanned against that bucket's array in each existing level: equal neighbours in
  the merged order are matches. Levels of equal rank merge into one of the next rank, so
  n batches are in at most log2(n) + 1 levels, each written at most log2(n) times;
* an h with more different segments than an array should hold is cut finer: windows at 32
  neighbouring distances from the anchor are a piece, pieces are told apart by digest, and
  only those that share their inner bytes with a different one are cut again, down to
  single windows. So a passage that very many texts have takes some rows for each.

A segment whose h occurs nowhere else needs no further look, nor does one whose h has only
segments that occur twice. A bitmap of fixed size keeps
most of those away; it only saves work, as everything is joined by h afterwards.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bitmap, in_bitmap, shared_dir
from .text import _strings, grams, signed, sliding_min

MATCH, GRAM = 200, 32
#: Bytes of text worked on at once; a longer text is cut into overlapping pieces. Below 2**24, see ``_segments``.
CHUNK = 1 << 19
#: Most different segments of an anchor hash that go into suffix arrays.
MOST_KINDS = 500
#: Segments that a bucket's array is meant to hold: some 17 MB of windows while it is worked on.
BUCKET = 1000
#: Different segments counted in one task before they are handed on.
FLUSH = 50_000
BROADCAST_BYTES = 64 << 20


def _pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Bytes, document bounds in them, first row and the first byte's place in its document, a bounded piece at a time.

    Each window of each document lies in exactly one piece.
    """
    data, offsets = _strings(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        if offsets[j] - offsets[i] <= CHUNK:
            yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i, 0
        else:  # one text
            for at in range(int(offsets[i]), max(int(offsets[j]) - MATCH + 1, int(offsets[i]) + 1), CHUNK):
                buf = data[at : min(at + CHUNK + MATCH - 1, offsets[j])]
                yield buf, np.array([0, len(buf)]), i, at - int(offsets[i])
        i = j


def _segments(buf: np.ndarray, cuts: np.ndarray):
    """Of each segment: first byte, windows, hash of the anchor, document."""
    none = np.empty(0, dtype=np.int64)
    if len(buf) < MATCH:
        return none, none, none.view(np.uint64), none
    g = grams(buf.astype(np.uint64), GRAM)
    low = np.uint64((1 << 24) - 1)
    least = sliding_min((g & ~low) | np.arange(len(g), dtype=np.uint64), MATCH - GRAM + 1)
    end = np.repeat(cuts[1:], np.diff(cuts))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + MATCH <= end)
    if not len(at):
        return none, none, none.view(np.uint64), none
    anchor = (least[at] & low).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
    start = at[new]
    return start, np.diff(np.r_[new, len(at)]), g[anchor[new]], np.searchsorted(cuts, start, side="right") - 1


def _digest(of: bytes) -> bytes:
    return hashlib.blake2b(of, digest_size=16).digest()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(h, digest, times): different segments of each task's share of the texts, counted before anything is shuffled."""

    def rows(found: dict) -> pa.RecordBatch:
        h, digest = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_pydict({"h": pa.array(h, pa.int64()), "digest": pa.array(digest, pa.binary()), "times": pa.array(list(found.values()), pa.int64())})

    def run(batches):
        found: dict[tuple[int, bytes], int] = {}
        for batch in batches:
            for buf, cuts, _, _ in _pieces(batch[0]):
                start, n, h, _ = _segments(buf, cuts)
                whole = buf.tobytes()
                for key, a, b in zip(signed(h).tolist(), start.tolist(), (start + n + MATCH - 1).tolist(), strict=True):
                    key = key, _digest(whole[a:b])
                    found[key] = found.get(key, 0) + 1
                if len(found) > FLUSH:
                    yield rows(found)
                    found = {}
        yield rows(found)

    return docs.select("text").mapInArrow(run, "h long, digest binary, times long")


def occurrences(docs: DataFrame, met, compared) -> DataFrame:
    """(h, digest, doc_id, part, pos, n, seg): segments whose h is in the bitmap ``met``.

    ``seg`` are the bytes, given once a batch of rows and only if h is in ``compared``.
    """
    fields = {"h": pa.int64(), "digest": pa.binary(), "doc_id": pa.int64(), "part": pa.int64(), "pos": pa.int64(), "n": pa.int32(), "seg": pa.binary()}

    def run(batches):
        for batch in batches:
            given: set[bytes] = set()
            for buf, cuts, row, shift in _pieces(batch[2]):
                start, n, h, doc = _segments(buf, cuts)
                keep = np.flatnonzero(in_bitmap(met.value, h))
                start, n, h, doc = start[keep], n[keep], h[keep], doc[keep]
                whole, digests, texts = buf.tobytes(), [], []
                for a, b, wanted in zip(start.tolist(), (start + n + MATCH - 1).tolist(), in_bitmap(compared.value, h).tolist(), strict=True):
                    text = whole[a:b]
                    digest = _digest(text)
                    digests.append(digest)
                    texts.append(text if wanted and digest not in given else None)
                    if wanted:
                        given.add(digest)
                at = pa.array(row + doc)
                columns = (signed(h), digests, batch[0].take(at), batch[1].take(at), start - cuts[doc] + shift, n, texts)
                yield pa.RecordBatch.from_pydict({k: pa.array(c, t) for (k, t), c in zip(fields.items(), columns, strict=True)})

    return docs.select("doc_id", "part", "text").mapInArrow(run, "h long, digest binary, doc_id long, part long, pos long, n int, seg binary")


# -- suffix arrays ---------------------------------------------------------------------

_BLOCK = "bucket int, h array<long>, digest array<binary>, n array<int>, text binary, suffixes binary"
_FOUND = "h long, digest binary, first int, end int"
#: A block with the ranges that were found while it was made: segment's place in the block, first and end window.
_MADE = _BLOCK + ", segment array<int>, first array<int>, end array<int>"


def _windows(text: bytes, n: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Every window of segments that lie one after the other in ``text``, in ``order``, as strings of 200 bytes; of this length they compare byte by byte."""
    past = np.r_[0, np.cumsum(n)]
    starts = np.arange(past[-1]) + np.repeat(np.arange(len(n)) * (MATCH - 1), n)
    if order is not None:
        starts = starts[order]
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, dtype=np.uint8), MATCH)
    return np.ascontiguousarray(view[starts]).view(f"S{MATCH}").ravel()


def _order(sorted_runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order (one linear merge where the input is two sorted runs) and which strings, by place in the input, have an equal."""
    order = np.argsort(sorted_runs, kind="stable")
    rows = sorted_runs.view(np.uint8).reshape(-1, MATCH)
    same = np.zeros(len(order), dtype=bool)
    step = 1 << 16
    for a in range(1, len(order), step):
        b = min(a + step, len(order))
        same[a:b] = (rows[order[a:b]] == rows[order[a - 1 : b - 1]]).all(axis=1)
    equal = np.zeros(len(order), dtype=bool)
    equal[order] = same | np.r_[same[1:], False]
    return order, equal


def _ranges(n: np.ndarray, equal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated windows, from flags of all windows of a block: segment's place, first and end window."""
    past = np.r_[0, np.cumsum(n)]
    seg = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(equal)
    if not len(at):
        return (np.empty(0, dtype=np.int32),) * 3
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (seg[at[1:]] != seg[at[:-1]])])
    own = seg[at[new]]
    return own.astype(np.int32), (at[new] - past[own]).astype(np.int32), (at[np.r_[new[1:], len(at)] - 1] + 1 - past[own]).astype(np.int32)


def _found(block, equal: np.ndarray) -> pd.DataFrame:
    own, first, end = _ranges(np.asarray(block.n), equal)
    return pd.DataFrame({"h": np.asarray(block.h)[own], "digest": [block.digest[i] for i in own], "first": first, "end": end})


def _made(bucket: int, h, digest, n, text: bytes, suffixes: np.ndarray, equal: np.ndarray) -> pd.DataFrame:
    own, first, end = _ranges(np.asarray(n), equal)
    return pd.DataFrame({"bucket": [bucket], "h": [h], "digest": [digest], "n": [n], "text": [text], "suffixes": [suffixes.astype(np.int32).tobytes()], "segment": [own], "first": [first], "end": [end]})


def _array(group: pd.DataFrame) -> pd.DataFrame:
    """The suffix array of a bucket's segments, and the windows that repeat within it: neighbours in its order."""
    n, text = group["n"].to_numpy(), b"".join(group["seg"])
    order, equal = _order(_windows(text, n))
    return _made(group["bucket"].iloc[0], group["h"].to_numpy(), list(group["digest"]), n, text, order, equal)


def _sorted(block) -> tuple[np.ndarray, np.ndarray]:
    """A block's windows in lexicographic order, and which window each is."""
    order = np.frombuffer(block.suffixes, dtype=np.int32)
    return _windows(block.text, np.asarray(block.n), order), order


def _one_after_the_other(a, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted windows of two blocks, and which window of its block each is."""
    (wa, oa), (wb, ob) = _sorted(a), _sorted(b)
    return np.concatenate([wa, wb]), oa, ob


def _scan(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """Windows that two arrays share, of both: one merge of the sorted orders."""
    if not len(new) or not len(old):
        return pd.DataFrame({"h": pd.Series(dtype="int64"), "digest": pd.Series(dtype="object"), "first": pd.Series(dtype="int32"), "end": pd.Series(dtype="int32")})
    a, b = next(new.itertuples()), next(old.itertuples())
    both, oa, ob = _one_after_the_other(a, b)
    _, equal = _order(both)
    fa, fb = np.zeros(len(oa), dtype=bool), np.zeros(len(ob), dtype=bool)
    fa[oa], fb[ob] = equal[: len(oa)], equal[len(oa) :]
    return pd.concat([_found(a, fa), _found(b, fb)])


def _merged(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """One array in place of two, and the windows that they share: the same merge."""
    none = np.empty(0, dtype=np.int32)
    if not len(new) or not len(old):
        a = next((new if len(new) else old).itertuples())
        return _made(a.bucket, a.h, a.digest, a.n, a.text, np.frombuffer(a.suffixes, dtype=np.int32), none)
    a, b = next(new.itertuples()), next(old.itertuples())
    both, oa, ob = _one_after_the_other(a, b)
    order, same = _order(both)
    suffixes = np.concatenate([oa, ob + np.int32(len(oa))])
    equal = np.zeros(len(suffixes), dtype=bool)
    equal[suffixes] = same
    return _made(a.bucket, np.r_[a.h, b.h], [*a.digest, *b.digest], np.r_[a.n, b.n], a.text + b.text, suffixes[order], equal)


class SuffixLevels:
    """Suffix arrays of all segments taken in so far: a folder of levels and a manifest.

    ``path`` names an index to go on with (in any session), else a new one is made in the
    shared folder. A level holds a row a bucket, so a task works on one bucket's arrays. Take
    ``buckets`` so that a bucket stays at some thousand segments; no h should have more
    than ``MOST_KINDS`` different ones (``repeats`` sees to that).
    """

    def __init__(self, spark: SparkSession, buckets: int = 64, path: str | None = None):
        self.spark, self.path = spark, (path or f"{shared_dir(spark)}/suffixes-{uuid.uuid4().hex[:12]}").rstrip("/")
        self.buckets, self.levels, self.version = buckets, [], 0
        if path:
            versions = self._versions()
            if not versions:
                raise ValueError(f"no index at {path}")
            self.version = max(versions)
            state = json.loads(spark.read.text(f"{self.path}/manifest-{self.version}").first()[0])
            self.buckets, self.levels = state["buckets"], [tuple(x) for x in state["levels"]]

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        at, fs = self._fs()
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        done = [n for n in names if n.startswith("manifest-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return [int(n.removeprefix("manifest-")) for n in done]

    def _commit(self, levels: list[tuple[int, str]], made: list[str]) -> None:
        """A manifest counts once it is complete; what only older ones name, or nothing, is deleted after that."""
        old, self.levels, self.version = [*self.levels, *[(0, name) for name in made]], levels, self.version + 1
        state = json.dumps({"buckets": self.buckets, "levels": levels})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{self.version}")
        _, fs = self._fs()
        for name in [n for _, n in old if n not in {x for _, x in levels}] + [f"manifest-{v}" for v in self._versions() if v < self.version]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    def _write(self, rows: DataFrame) -> str:
        name = f"level-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(_BLOCK).parquet(f"{self.path}/{name}")

    def ingest(self, segments: DataFrame) -> DataFrame:
        """Take in different ``segments`` (h, digest, n, seg) of a batch; give (h, digest, first, end): ranges of windows that also start elsewhere.

        These are windows of the batch, and of older segments that the batch meets. Ranges
        can come more than once. A level of equal rank is scanned and merged in one go. The
        result is read from files that the caller may delete with the folder ``found-...``
        of the index.
        """
        rows = segments.select(F.expr(f"cast(pmod(h, {self.buckets}) as int)").alias("bucket"), "h", "digest", "n", "seg")
        fresh = new = self._write(rows.groupBy("bucket").applyInPandas(_array, _MADE))
        made, levels, rank, found = [new], list(self.levels), 0, None
        while levels and levels[-1][0] == rank:
            other = levels.pop()[1]
            new, rank = self._write(self._read(new).groupBy("bucket").cogroup(self._read(other).groupBy("bucket")).applyInPandas(_merged, _MADE)), rank + 1
            made.append(new)
        for _, level in levels:
            scanned = self._read(fresh).groupBy("bucket").cogroup(self._read(level).groupBy("bucket")).applyInPandas(_scan, _FOUND)
            found = scanned if found is None else found.unionByName(scanned)
        for name in made:
            each = self.spark.read.schema(_MADE).parquet(f"{self.path}/{name}").select("h", "digest", F.explode(F.arrays_zip("segment", "first", "end")).alias("r"))
            each = each.select(F.get("h", F.col("r.segment")).alias("h"), F.get("digest", F.col("r.segment")).alias("digest"), "r.first", "r.end")
            found = each if found is None else found.unionByName(each)
        out = f"{self.path}/found-{uuid.uuid4().hex[:12]}"
        found.write.parquet(out)
        self._commit([*levels, (rank, new)], made)
        return self.spark.read.schema(_FOUND).parquet(out)

    def delete(self) -> None:
        at, fs = self._fs()
        fs.delete(at, True)


# -- the whole table -------------------------------------------------------------------


#: Neighbouring distances from the anchor whose windows are compared together, step by step.
PIECES = (32, 8, 2, 1)


def _cut(segments: DataFrame, size: int) -> DataFrame:
    """(core, whole, h, digest, first, n, seg): segments or pieces (h, digest, first, n, seg) cut into windows at ``size`` neighbouring distances from the anchor.

    ``whole`` is a digest of a piece's bytes and place, ``core`` one of the bytes that all
    windows at its distances have: equal windows lie in pieces of equal core.
    """
    fields = {"core": pa.binary(), "whole": pa.binary(), "h": pa.int64(), "digest": pa.binary(), "first": pa.int32(), "n": pa.int32(), "off": pa.int32(), "seg": pa.binary()}

    def run(batches):
        for batch in batches:
            for h, digest, first, n, off, seg in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows, i = [], 0
                while i < n:  # window i starts off - i bytes before the anchor
                    step = (off - i) // size
                    end = min(n, off - step * size + 1)
                    tag = f"{h} {step} {size} ".encode()
                    core = seg[off - step * size : off - step * size - size + 1 + MATCH]
                    rows.append((_digest(tag + core), _digest(tag + f"{off - i} ".encode() + seg[i : end + MATCH - 1]), h, digest, first + i, end - i, off - i, seg[i : end + MATCH - 1]))
                    i = end
                yield pa.RecordBatch.from_pydict({k: pa.array(c, t) for (k, t), c in zip(fields.items(), zip(*rows, strict=True), strict=True)})

    return segments.select("h", "digest", "first", "n", "off", "seg").mapInArrow(run, "core binary, whole binary, h long, digest binary, first int, n int, off int, seg binary")


def _distance(seg: bytes) -> int:
    """Of a segment's first window: bytes from its start to its anchor."""
    return int(np.argmin(grams(np.frombuffer(seg[:MATCH], dtype=np.uint8).astype(np.uint64), GRAM) >> np.uint64(24)))


def _in_pieces(segments: DataFrame, scratch: Scratch) -> DataFrame:
    """The same ranges for segments (h, digest, n, seg) of very common anchors, whatever their number."""

    @F.pandas_udf("int")
    def distance(segs: pd.Series) -> pd.Series:
        return segs.map(_distance)

    ranges, rows = None, segments.select("h", "digest", F.lit(0).alias("first"), "n", distance("seg").alias("off"), "seg")
    for size in PIECES:
        rows = scratch.save(_cut(rows, size), f"pieces-{size}")
        kinds = rows.groupBy("core", "whole").agg(F.count("*").alias("times"), F.min(F.struct("h", "digest", "first", "n", "off", "seg")).alias("one"))
        kinds = scratch.save(kinds, f"kinds-{size}")
        found = rows.join(kinds.filter("times > 1").select("whole"), "whole").select("h", "digest", "first", (F.col("first") + F.col("n")).alias("end"))
        ranges = found if ranges is None else ranges.unionByName(found)
        open_ = kinds.groupBy("core").agg(F.count("*").alias("n"), F.min("times").alias("least")).filter("n > 1 and least = 1").select("core")
        rows = kinds.join(open_, "core", "left_semi").select("one.*")
    return ranges


def repeats(docs: DataFrame, batches: int = 3) -> tuple[DataFrame, Scratch]:
    """(doc_id, part, spans): byte ranges first, end, first, end ... of ``docs`` (doc_id, part, text) that repeated windows cover.

    The texts are taken into the levels as ``batches`` batches, dealt by a hash of doc_id.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    pieces = scratch.save(fingerprints(docs).groupBy("h", "digest").agg(F.sum("times").alias("times")), "pieces")
    met = pieces.groupBy("h").agg(F.count("*").alias("kinds"), F.min("times").alias("least"), F.max("times").alias("most")).filter("kinds > 1 or most > 1")
    met = scratch.save(met.drop("most"), "met")
    again = scratch.save(pieces.filter("times > 1").select("h", "digest"), "again")
    scratch.drop("pieces")
    compared = met.filter("kinds > 1 and least = 1")  # where all occur twice there is nothing left to find
    bits = bitmap(spark, met, "h"), bitmap(spark, compared, "h")
    found = occurrences(docs, *bits).withColumn("batch", F.expr(f"cast(pmod(crc32(cast(coalesce(doc_id, 0) as string)), {batches}) as int)"))
    found = scratch.save(found, "occurrences")
    segments = found.filter("seg is not null").groupBy("batch", "h", "digest").agg(F.max("seg").alias("seg"), F.max("n").alias("n")).join(compared, "h")
    segments = scratch.save(segments, "segments")
    for used in bits:
        used.destroy()

    ranges = again.withColumns({"first": F.lit(0), "end": F.lit(None).cast("int")})
    common = segments.filter(F.col("kinds") > MOST_KINDS).groupBy("h", "digest").agg(F.max("seg").alias("seg"), F.max("n").alias("n"))
    ranges = ranges.unionByName(_in_pieces(common, scratch))
    few = segments.filter(F.col("kinds") <= MOST_KINDS)
    count = few.count()
    levels = SuffixLevels(spark, max(1, -(-count // BUCKET)))
    for k in range(batches if count else 0):
        ranges = ranges.unionByName(levels.ingest(few.filter(F.col("batch") == k)))
    ranges = scratch.save(ranges.distinct(), "ranges")
    scratch.drop("again", "met", "segments", *[f"{t}-{size}" for t in ("pieces", "kinds") for size in PIECES])
    levels.delete()

    # both sides are tables, so that the join of a passage that very many documents have can be split
    covered = found.drop("seg").join(ranges, ["h", "digest"]).select("doc_id", "part", F.expr(f"shiftleft(pos + first, 32) | (pos + coalesce(end, n) + {MATCH - 1})").alias("cover"))

    @F.pandas_udf("array<long>")
    def union(covers: pd.Series) -> pd.Series:
        out = []
        for cover in covers:
            both = np.sort(cover)
            first, end = both >> 32, np.maximum.accumulate(both & 0xFFFFFFFF)
            new = np.flatnonzero(np.r_[True, first[1:] > end[:-1]])
            out.append(np.c_[first[new], end[np.r_[new[1:], len(end)] - 1]].ravel())
        return pd.Series(out)

    spans = covered.groupBy("doc_id", "part").agg(F.collect_list("cover").alias("cover")).select("doc_id", "part", union("cover").alias("spans"))
    spans = scratch.save(spans, "spans")
    scratch.drop("occurrences", "ranges")
    return spans, scratch


def drop_repeated_bytes(docs: DataFrame, batches: int = 3) -> DataFrame:
    """(doc_id, n_bytes, n_spans, kept): what is left of each text, as bytes (a cut can fall inside a character).

    Every occurrence of a repeated 200-byte string goes, the first as well. Null texts are
    empty; rows with a null or a repeated id are documents like others (equal rows are
    copies of each other); an empty table gives no rows. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("part", F.xxhash64("text"))
    spans, _ = repeats(docs, batches)
    n, values = spans.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    spans = spans.select(F.col("doc_id").alias("span_id"), F.col("part").alias("span_part"), "spans")
    if 48 * n + 8 * values <= BROADCAST_BYTES:
        spans = F.broadcast(spans)

    @F.pandas_udf("binary")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, gone in zip(texts, spans, strict=True):
            if gone is None:
                out.append(None)
            else:
                out.append(b"".join(text[a:b] for a, b in zip([0, *gone[1::2].tolist()], [*gone[::2].tolist(), len(text)], strict=True)))
        return pd.Series(out, dtype="object")

    rows = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("part") == F.col("span_part")), "left")
    whole = F.col("text").cast("binary")
    # only changed texts are handed to Python
    kept = F.coalesce(cut(F.when(F.col("spans").isNotNull(), whole), "spans"), whole)
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.coalesce(F.size("spans") / 2, F.lit(0)).cast("long").alias("n_spans"), kept.alias("kept"))


def op12_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    rows = drop_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
with doc as (
  select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents
), piece as (
  select r, j, substr(x, 4000 * j + 1, 4398) as y from (select r, x, unnest(range(0, (len(x) + 3999) // 4000)) as j from doc)
), win as (
  select r, 2000 * j + k as i, md5(substr(y, 2 * k + 1, 400)) as w from (select r, j, y, unnest(range(0, least(2000, len(y) // 2 - 199))) as k from piece where len(y) >= 400)
), hit as (
  select r, i from win where w in (select w from win group by w having count(*) > 1)
), span as (
  select r, min(i) as a, max(i) + 200 as e
  from (select r, i, sum(new) over (partition by r order by i) as g from (select r, i, (i > coalesce(lag(i) over (partition by r order by i), -201) + 200)::int as new from hit))
  group by r, g
), cut as (
  select r, a, substr(x, 2 * before + 1, 2 * (a - before)) as piece from (select r, a, coalesce(lag(e) over (partition by r order by a), 0) as before from span) join doc using (r)
  union all
  select r, 1000000000000, substr(x, 2 * last + 1) from (select r, max(e) as last from span group by r) join doc using (r)
), kept as (
  select r, string_agg(piece, '' order by a) as x from cut group by r
), gone as (
  select r, sum(e - a) as n, count(*) as spans from span group by r
)
select doc_id, cast(len(doc.x) // 2 as bigint) as n_bytes, cast(coalesce(n, 0) as bigint) as n_removed, cast(coalesce(spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept.x, doc.x))) as kept_sha256
from doc left join kept using (r) left join gone using (r)
"""
