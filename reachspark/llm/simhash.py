"""SimHash near-duplicates found with pivot distance tables (operator 8).

``fingerprints`` hashes whole texts. ``links`` finds all pairs of *different*
fingerprints that differ in at most ``distance`` bits:

* equal fingerprints are one row first, so groups of copies cost nothing;
* distances of random 64-bit fingerprints to any pivot lie close to 32, so a pivot table
  alone would have to look at all pairs; pairs therefore meet only where they agree on
  ``keep`` of ``blocks`` bit blocks (with ``blocks - keep`` differing bits at most, some
  ``keep`` blocks are equal), which loses none;
* within such a meeting place the table of Hamming distances to the pivots is laid out
  once. By the triangle inequality a pair with a coordinate difference above ``distance``
  can't be a link; such pairs are discarded, and what survives is verified by XOR;
* a meeting place gives a spanning forest of its links, not all of its pairs; one with
  more than ``most`` fingerprints is put off and worked off in square tiles.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PART, Bitmap, Scratch, bitmap, components, in_bitmap, without
from .text import SPACED_FOLDED, chunks, grams, mix, signed

SEED = 42
#: Reference fingerprints, the same in every run.
PIVOTS = mix(np.arange(1, 17, dtype=np.uint64))
_SMALL = 24
#: So many ids (8 MB) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: The pipeline's own rule: words of a shingle, and the Jaccard similarity from which texts are copies.
SHINGLE, SIMILARITY = 5, 0.8
#: MinHash keys of a text; of pairs at a similarity of 0.8, (1 - 0.8**4)**24 = 3 in a million never meet.
BANDS = 24
#: So many shingles (32 MB) of one meeting place are compared in one task.
PLACE_SHINGLES = 4_000_000
_TURNS = mix(np.arange(1000, 1000 + 4 * BANDS, dtype=np.uint64)).reshape(BANDS, 4) | np.uint64(1)


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): bit i is set where over half of the shingles' XXH64 have it.

    Null and empty texts have fingerprint zero; a text of fewer words than a shingle is
    one shingle. Every row gives a row, repeated ids included.
    """

    def run(batches):
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = np.zeros(len(batch), dtype=np.uint64)
            for w in chunks(batch[1], SPACED_FOLDED):
                n = np.diff(w.first)
                if not len(w.starts):
                    continue
                # the words of each document, one space after each
                keep = np.zeros(len(w.buf) + 1, dtype=bool)
                word = np.zeros(len(w.buf) + 1, dtype=np.int8)
                word[w.starts] += 1
                np.subtract.at(word, w.ends, 1)
                keep[:-1] = np.cumsum(word[:-1]) > 0
                gap = w.ends[~keep[w.ends]]
                keep[gap] = True
                buf = np.append(w.buf, np.uint8(32))
                buf[gap] = 32
                to = np.cumsum(keep) - keep
                lean = buf[keep].tobytes()
                a, b = to[w.starts], to[w.ends - 1] + 1
                left = w.left()
                whole = left >= shingle
                whole[w.first[:-1][n > 0]] = True  # short texts are one shingle
                at = np.flatnonzero(whole)
                end = np.minimum(at + shingle, at + left[at]) - 1
                h = np.fromiter((digest(lean[x:y], SEED) for x, y in zip(a[at].tolist(), b[end].tolist(), strict=True)), dtype=np.uint64, count=len(at))
                first = np.searchsorted(at, w.first)
                for i in np.flatnonzero(n):
                    out[w.rows.start + i] = majority(h[first[i] : first[i + 1]])
            yield pa.RecordBatch.from_pydict({"doc_id": batch[0], "fp": pa.array(signed(out))})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def majority(h: np.ndarray) -> np.uint64:
    """The bits set in over half of the hashes."""
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * count > len(h), bitorder="little").view(np.uint64)[0]


def _coordinates(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among one meeting place's fingerprints."""
    table = _coordinates(fp)
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    open_ = np.arange(len(fp))  # not reached yet, in the order of the first coordinate
    a, b = [], []
    while len(open_):
        front, open_ = [open_[0]], open_[1:]
        while front and len(open_):
            x = front.pop()
            low, high = np.searchsorted(table[open_, 0], [table[x, 0] - distance, table[x, 0] + distance + 1])
            near = open_[low:high]
            near = near[np.abs(table[near] - table[x]).max(axis=1, initial=0) <= distance]
            near = near[np.bitwise_count(fp[near] ^ fp[x]) <= distance]
            if len(near):
                a.append(np.full(len(near), fp[x]))
                b.append(fp[near])
                front.extend(near.tolist())
                open_ = np.setdiff1d(open_, near, assume_unique=True)
    none = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _meet(distance: int, most: int):
    """For rows sorted by their meeting place: links of kind 0; kind 1 puts a place off, with its size in b."""

    def small(key, fp, starts, sizes):
        a, b = [], []
        table = _coordinates(fp)
        for step in range(1, int(sizes.max(initial=1))):
            i = np.flatnonzero(key[:-step] == key[step:])
            i = i[np.abs(table[i] - table[i + step]).max(axis=1, initial=0) <= distance]
            i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= distance]
            a.append(fp[i])
            b.append(fp[i + step])
        return a, b

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the last place of what came, still open
        size, late = 0, None

        def work(key, fp):
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1])])
            sizes = np.diff(np.r_[new, len(key)])
            a, b = [], []
            few = np.repeat((sizes > 1) & (sizes <= _SMALL), sizes)
            if few.any():
                x, y = small(key[few], fp[few], new, sizes[(sizes > 1) & (sizes <= _SMALL)])
                a += x
                b += y
            for s, n in zip(new[sizes > _SMALL], sizes[sizes > _SMALL], strict=True):
                x, y = forest(fp[s : s + n], distance)
                a.append(x)
                b.append(y)
            if not a:
                return None
            a, b = np.concatenate(a), np.concatenate(b)
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return batch_of(np.zeros(len(pair), np.int32), signed(np.ascontiguousarray(pair[:, 0])), signed(np.ascontiguousarray(pair[:, 1]))) if len(pair) else None

        def batch_of(kind, a, b):
            return pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            key, fp = batch[0].to_numpy(zero_copy_only=False), batch[1].to_numpy(zero_copy_only=False).view(np.uint64)
            if late is not None:  # counts a place that is put off
                n = int(np.searchsorted(key, late, side="right")) if len(key) and key[0] == late else 0
                size += n
                key, fp = key[n:], fp[n:]
                if not len(key):
                    continue
                yield batch_of([1], [late], [size])
                late, size = None, 0
            held.append((key, fp))
            key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut and (out := work(key[:cut], fp[:cut])) is not None:
                yield out
            key, fp = key[cut:], fp[cut:]
            held = [(key, fp)]
            if len(key) > most:
                late, size, held = key[-1], len(key), []
        if late is not None:
            yield batch_of([1], [late], [size])
        elif held:
            key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(key) and (out := work(key, fp)) is not None:
                yield out

    return run


def links(scratch: Scratch, distinct: DataFrame, distance: int = 4, blocks: int = 7, most: int = 20_000) -> DataFrame:
    """(a, b): links that connect what any pair of ``distinct.fp`` within ``distance`` bits connects."""
    keep = blocks - distance
    if keep < 1:
        raise ValueError("more blocks than differing bits are needed")
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    shift = [f"(shiftrightunsigned(fp, {a}) & {(1 << (b - a)) - 1}L)" for a, b in zip(edges[:-1], edges[1:], strict=True)]
    width = [int(b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), keep)):
        key = f"{n}L"
        for c in chosen:
            key = f"(shiftleft({key}, {width[c]}) | {shift[c]})"
        keys.append(key)
    met = distinct.select("fp", F.explode(F.array(*[F.expr(k) for k in keys])).alias("key")).select("key", "fp")
    found = scratch.save(met.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_meet(distance, most), "kind int, a long, b long"), "met")
    late = found.filter("kind = 1").select(F.col("a").alias("key"), F.ceil(F.col("b") * 2 / most).cast("int").alias("tiles"))
    out = found.filter("kind = 0").select("a", "b")
    if late.isEmpty():
        return out.distinct()
    tiled = met.join(late, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
    # a tile holds about `most` rows; its size is no longer limited, since it is made to fit
    again = tiled.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_meet(distance, 1 << 62), "kind int, a long, b long")
    return out.unionByName(scratch.save(again, "tiles").select("a", "b")).distinct()


def _near(table: DataFrame) -> DataFrame:
    """One row for each component: broadcast up to BROADCAST_ROWS, so that a component of most rows isn't one task's; beyond, adaptive execution splits it."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, most: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links reach.

    Null or empty texts share fingerprint zero and so form one group; repeated rows each
    give a row; null ids are ignored by the minimum (a group of null ids only has a null
    component_id); an empty table gives no rows. Other columns of ``docs`` are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.save(fingerprints(docs, shingle, id_col, text_col), "fps")
    distinct = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = components(scratch, links(scratch, distinct, distance, distance + 3, most))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_fp = scratch.save(named.join(_near(scratch.save(least, "least")), "root").select("fp", "component_id"), "classes")
    scratch.drop("met", "tiles", "distinct", "least")
    return fps.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE, only: Bitmap | None = None) -> DataFrame:
    """(doc_id, part, fp, n, sim, bands): of each text's runs of ``shingle`` words, once each, a hash of them all, their number, their SimHash and MinHash keys.

    With ``only``, a bitmap of fingerprints, (fp, hashes): the sets themselves, of texts in it.
    """

    def lists(x, cuts):
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(signed(np.ascontiguousarray(x))))

    def run(batches):
        for batch in batches:
            for w in chunks(batch[2], SPACED_FOLDED):
                n, words = np.diff(w.first), w.hashes()
                whole = grams(words, shingle)
                sets = []
                for i, k in enumerate(n):
                    at = w.first[i]
                    # a text of fewer words than a shingle is one shingle
                    sets.append(np.unique(whole[at : at + k - shingle + 1]) if k >= shingle else grams(words[at : at + k], int(k)) if k else words[:0])
                size = np.array([len(x) for x in sets])
                flat = np.concatenate(sets)
                first = np.r_[0, np.cumsum(size)]
                fp, sim, bands = np.zeros(len(n), dtype=np.uint64), np.zeros(len(n), dtype=np.uint64), np.zeros((len(n), BANDS), dtype=np.uint64)
                some = np.flatnonzero(size)
                if len(some):
                    with np.errstate(over="ignore"):
                        fp[some] = mix(np.add.reduceat(mix(flat), first[some]) + size[some].astype(np.uint64))
                if only is not None:
                    wanted = np.flatnonzero(in_bitmap(only.value, fp))
                    if len(wanted):
                        yield pa.RecordBatch.from_arrays([pa.array(signed(fp[wanted])), lists(np.concatenate([sets[i] for i in wanted]), np.r_[0, np.cumsum(size[wanted])])], names=["fp", "hashes"])
                    continue
                if len(some):
                    with np.errstate(over="ignore"):
                        for b in range(BANDS):
                            key = np.full(len(some), b + 1, dtype=np.uint64)
                            for m in _TURNS[b]:
                                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(flat * m, first[some]))
                            bands[some, b] = key
                    for i in some:
                        sim[i] = majority(mix(sets[i]))
                rows = slice(w.rows.start, w.rows.stop)
                yield pa.RecordBatch.from_arrays(
                    [batch[0][rows], batch[1][rows], pa.array(signed(fp)), pa.array(size, pa.int32()), pa.array(signed(sim)), lists(bands.ravel(), np.arange(len(n) + 1) * BANDS)], names=["doc_id", "part", "fp", "n", "sim", "bands"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(PART).alias("part"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part int, fp long, n int, sim long, bands array<long>" if only is None else "fp long, hashes array<long>")


def jaccard_forest(first: np.ndarray, flat: np.ndarray, root: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links, at least ``similarity`` of Jaccard, that connect what all such links among the sets flat[first[i]:first[i + 1]] connect; equal ``root`` counts as connected."""
    size = np.diff(first)
    codes = np.unique(flat, return_inverse=True)[1]
    mark = np.zeros(len(flat), dtype=np.int32)
    _, root = np.unique(root, return_inverse=True)
    by_root = np.argsort(root, kind="stable")
    ends = np.cumsum(np.bincount(root))
    members = lambda r: by_root[(ends[r - 1] if r else 0) : ends[r]]

    def lean(at):
        """Sets of these rows only, from the smallest to the largest."""
        at = at[np.argsort(size[at], kind="stable")]
        begin = np.r_[0, np.cumsum(size[at])]
        return at, begin, codes[np.arange(begin[-1]) + np.repeat(first[at] - begin[:-1], size[at])]

    waiting = np.ones(len(size), dtype=bool)
    at, begin, held = lean(np.arange(len(size)))
    a, b = [], []
    for seed in range(len(size)):
        if not waiting[seed]:
            continue
        front = members(root[seed]).tolist()
        waiting[front] = False
        while front:
            left = int(waiting[at].sum())
            if not left:
                break
            if 2 * left < len(at):
                at, begin, held = lean(at[waiting[at]])
            x = front.pop()
            low, high = np.searchsorted(size[at], [(similarity - 1e-9) * size[x], size[x] / (similarity - 1e-9) + 1e-9], side="left")
            if low == high:
                continue
            mark[codes[first[x] : first[x + 1]]] = 1
            both = np.add.reduceat(mark[held[begin[low] : begin[high]]], begin[low:high] - begin[low])
            mark[codes[first[x] : first[x + 1]]] = 0
            near = at[low:high][waiting[at[low:high]] & (both / (size[x] + size[at[low:high]] - both) >= similarity)]
            reached, one = np.unique(root[near], return_index=True)
            for r, y in zip(reached, near[one], strict=True):
                a.append(x)
                b.append(int(y))
                waiting[members(r)] = False
                front.extend(members(r).tolist())
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def _connect(similarity: float):
    """For rows (key, fp, root, hashes) sorted by key: the links that each place's texts need."""

    def work(rows):
        table = pa.Table.from_batches(rows)
        key, fp, root = (table[name].to_numpy() for name in ("key", "fp", "root"))
        sets = table["hashes"].combine_chunks()
        first = np.r_[0, np.cumsum(sets.value_lengths().to_numpy())]
        flat = sets.flatten().to_numpy()
        new = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
        for s, e in zip(new[:-1], new[1:], strict=True):
            x, y = jaccard_forest(first[s : e + 1] - first[s], flat[first[s] : first[e]], root[s:e], similarity)
            if len(x):
                yield pa.RecordBatch.from_pydict({"a": pa.array(fp[s:e][x]), "b": pa.array(fp[s:e][y])})

    def run(batches):
        held: list[pa.RecordBatch] = []  # the last place of what came, still open
        for batch in batches:
            key = batch[0].to_numpy()
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if cut or held and held[-1][0][-1].as_py() != key[0]:
                yield from work([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from work(held)

    return run


def simhash_pairs(scratch: Scratch, texts: DataFrame, distance: int = 4, most: int = 20_000) -> DataFrame:
    """(a, an, b, bn): pairs of ``texts`` (fp, n, sim) that connect all whose SimHashes differ in at most ``distance`` bits.

    SimHashes meet and are held against the pivots' table of distances as in ``links``; the
    least text under each stands for it, and the others under it are its partners.
    """
    least = scratch.save(texts.groupBy("sim").agg(F.min(F.struct("fp", "n")).alias("least"), F.count("*").alias("c")), "sims")
    found = scratch.save(links(scratch, least.select(F.col("sim").alias("fp")), distance, distance + 3, most), "sim-links")
    scratch.drop("met", "tiles")
    side = lambda x: least.select(F.col("sim").alias(f"{x}s"), F.col("least.fp").alias(x), F.col("least.n").alias(f"{x}n"))
    across = found.withColumnsRenamed({"a": "as", "b": "bs"}).join(side("a"), "as").join(side("b"), "bs").select("a", "an", "b", "bn")
    same = texts.join(least.filter("c > 1").select("sim", "least"), "sim").filter("fp != least.fp")
    return across.unionByName(same.select(F.col("least.fp").alias("a"), F.col("least.n").alias("an"), F.col("fp").alias("b"), F.col("n").alias("bn")))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, most: int = PLACE_SHINGLES) -> DataFrame:
    """doc_id, part, kept: whether a row names its component, of texts linked by at least this Jaccard similarity of their shingle sets.

    The row with the smallest doc_id names it, of those the one with the smallest part; null ids come last.

    Equal sets are one row. SimHashes of the sets come first: texts at 4 or fewer differing
    bits, found with pivot distance tables, are linked where their whole sets verify it. 64
    bits don't reach a similarity of 0.8 (some 10 of them differ then), so what they leave
    apart meets where a band of MinHashes agrees, and every link is verified on the whole
    sets too. In a meeting place what is not connected to the least text yet is held against
    it first; places whose texts are not connected by that get their
    texts' sets and give the links of a spanning forest, so that no pairs are rows. A place
    of over ``most`` shingles in all is worked off in pairs of tiles of about that size.
    """
    scratch = Scratch(docs.sparkSession, "near-copies")
    rows = scratch.save(shingle_sets(docs, shingle), "rows")
    texts = rows.filter("n > 0").dropDuplicates(["fp"])

    def verified(pairs, name):
        fits = F.least("an", "bn") >= similarity * F.greatest("an", "bn")
        pairs = scratch.save(pairs.filter(fits).select("a", "b").distinct(), f"{name}-pairs")
        # sets are made again for texts of some pair; to keep those of all would take more room than the texts
        only = bitmap(docs.sparkSession, pairs.select(F.explode(F.array("a", "b")).alias("fp")), "fp")
        sets = scratch.save(shingle_sets(docs, shingle, only).dropDuplicates(["fp"]), f"{name}-sets")
        only.destroy()
        side = lambda x: sets.select(F.col("fp").alias(x), F.col("hashes").alias(f"h{x}"))
        both = F.size(F.array_intersect("ha", "hb"))
        alike = both / (F.size("ha") + F.size("hb") - both) >= similarity
        out = scratch.save(pairs.join(side("a"), "a").join(side("b"), "b").filter(alike).select("a", "b"), name)
        scratch.drop(f"{name}-pairs", f"{name}-sets")
        return out

    by_sim = Scratch(docs.sparkSession, "near-copies-simhash")
    sims = verified(simhash_pairs(by_sim, scratch.save(texts.select("fp", "n", "sim"), "texts")), "sims")
    by_sim.drop("sims", "sim-links")
    roots = scratch.save(components(scratch, sims, "sims-links"), "sim-roots")
    met = texts.select("fp", "n", F.explode("bands").alias("key"))
    many = met.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("fp", "n")).alias("least")).filter("c > 1").select("key", "least")
    met = scratch.save(met.join(many, "key"), "met")
    of = lambda x, root: roots.select(F.col("node").alias(x), F.col("root").alias(root))
    apart = met.filter("fp != least.fp").select(F.col("least.fp").alias("a"), F.col("least.n").alias("an"), F.col("fp").alias("b"), F.col("n").alias("bn")).distinct()
    apart = apart.join(of("a", "ar"), "a", "left").join(of("b", "br"), "b", "left").filter(F.coalesce("ar", "a") != F.coalesce("br", "b"))
    stars = sims.unionByName(verified(apart, "stars"))
    roots = scratch.save(components(scratch, stars, "stars"), "star-roots")
    named = met.join(roots, met.fp == roots.node, "left").select("key", "fp", "n", F.coalesce("root", "fp").alias("root"))
    # places whose texts are not connected yet; one of many shingles is worked off in pairs of tiles
    open_ = named.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.sum("n").alias("total")).filter("r0 != r1")
    open_ = open_.select("key", F.when(F.col("total") <= most, 1).otherwise(F.ceil(F.col("total") * 2 / most)).cast("int").alias("tiles"))
    named = scratch.save(named.join(open_, "key").select("key", "fp", "root", "tiles"), "open")
    own, other = F.pmod(F.xxhash64("fp"), F.col("tiles")), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = named.select("*", own.alias("own"), other.alias("other")).filter("tiles = 1 or own != other")
    dealt = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp", "root")
    only = bitmap(docs.sparkSession, named, "fp")
    sets = scratch.save(shingle_sets(docs, shingle, only).dropDuplicates(["fp"]), "open-sets")
    only.destroy()
    dealt = dealt.join(sets, "fp").select("key", "fp", "root", "hashes").repartition("key").sortWithinPartitions("key", "fp")
    rest = scratch.save(dealt.mapInArrow(_connect(similarity), "a long, b long"), "rest")
    roots = components(scratch, stars.unionByName(rest), "links")
    roots = _near(scratch.save(roots, "roots"))
    of_row = rows.select("doc_id", "part", "fp").join(roots, F.col("fp") == F.col("node"), "left").select("doc_id", "part", F.coalesce("root", "fp").alias("root"))
    of_row = scratch.save(of_row, "of-row")
    least = of_row.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "part")).alias("least"))
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("part") == F.col("least.part"))
    out = scratch.save(of_row.join(_near(scratch.save(least, "least")), "root").select("doc_id", "part", kept.alias("kept")), "classes")
    scratch.drop("rows", "texts", "sims", "sim-roots", "met", "stars", "star-roots", "open", "open-sets", "rest", "of-row", "least", "roots")
    return out


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one that names the group; of equal rows under one id or none, one."""
    scratch = Scratch(spark, "simhash-stage")
    rows = near_copies(docs)
    gone = scratch.save(rows.filter("not kept").select("doc_id", "part").distinct(), "gone")
    more = scratch.save(rows.filter("kept").groupBy("doc_id", "part").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "part"), "more")
    out = without(docs, gone, BROADCAST_ROWS)
    if more.isEmpty():
        return out
    own = [F.col("doc_id").cast("long").alias("own_id"), F.expr(PART).alias("own_part")]
    equal = out.select(F.struct("*").alias("whole"), *own).join(more, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_part") == F.col("part")), "left_semi")
    return without(out, more, BROADCAST_ROWS).unionByName(equal.groupBy("own_id", "own_part").agg(F.min_by("whole", F.to_json("whole")).alias("whole")).select("whole.*"))
