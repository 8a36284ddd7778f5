"""Spelling variants by a trie of letter counts (operator 13).

Letters fall into groups; a word's *vector* counts its letters by group. The trie has the
words by their successive counts. One edit changes a vector by a surplus of at most one
and a deficit of at most one, so ``Trie.search`` goes down depth first with a budget of one
each: at every level on with the same count, or one more, or one less, while the budget
lasts. Words at the leaves are verified letter by letter. A pair is looked for from one
side only: the first difference has to be a surplus; within a vector, from the lesser word.

The trie is dealt out by its nodes at a depth at which none holds more than
``MOST_WORDS``; a word is sent to the nodes that its budget reaches (1 + g + g(g-1)/2 at
depth g). A node that is larger even at full depth (anagrams) is cut into tiles, each of
which gets all of its visitors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .text import mix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letter groups of the trie's levels; what is in none (letters beyond ASCII) is a group of its own.
GROUPS = ("e", "t", "a", "o", "i", "n", "s", "r", "h", "l", "d", "u", "c", "m", "fw", "yp", "gb", "vkjxqz")
LEAST_LENGTH, LEAST_TIMES, FACTOR = 7, 2, 10
#: Words of one node that a task builds a trie of.
MOST_WORDS = 50_000
#: Words that a task is meant to get.
TASK_WORDS = 25_000
#: Pairs verified at once, and the letters up to which that is done in matrices.
PAIRS, WIDTH = 200_000, 32

_GROUP = np.full(256, len(GROUPS))
for _k, _letters in enumerate(GROUPS):
    _GROUP[list(_letters.encode())] = _k
LEVELS = len(GROUPS) + 1


def vectors(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Letter counts by group of words that lie one after the other in ``flat``."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(owner * LEVELS + _GROUP[flat], minlength=len(lengths) * LEVELS).reshape(-1, LEVELS)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and lengths of a binary column."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.empty(0, np.uint8), np.diff(offsets)


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges first .. first + count: which range and which member, all one after the other."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]


class Words:
    """Words with their vectors and, up to WIDTH letters, matrices flush left and flush right."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths, self.ends = flat, lengths, np.cumsum(lengths)
        self.counts = vectors(flat, lengths)
        n = np.minimum(lengths, WIDTH)
        row, at = _spread(np.zeros(len(lengths), dtype=np.int64), n)
        self.left, self.right = np.zeros((2, len(lengths), WIDTH), dtype=np.uint8)
        self.left[row, at] = flat[(self.ends - lengths)[row] + at]
        self.right[row, at] = flat[self.ends[row] - 1 - at]

    def word(self, i: int) -> bytes:
        return self.flat[self.ends[i] - self.lengths[i] : self.ends[i]].tobytes()


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters that rows have in common from the start."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def near(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Which words a[i] become b[j], of equal length or one letter longer, by exactly one replaced or inserted letter."""
    short, more = a.lengths[i], b.lengths[j] - a.lengths[i]
    same = _common(a.left[i], b.left[j]) + _common(a.right[i], b.right[j])
    out = (same >= short - 1 + more) & (same < 2 * WIDTH)  # equal words are no pair
    for k in np.flatnonzero(np.maximum(short, b.lengths[j]) > WIDTH):
        x, y = a.word(i[k]), b.word(j[k])
        at = next((t for t in range(len(x)) if x[t] != y[t]), len(x))
        out[k] = x != y and x[at + 1 - int(more[k]) :] == y[at + 1 :]
    return out


class Trie:
    """Words in the order of their vectors; a node is a range of them that agree in their first counts."""

    def __init__(self, words: Words):
        self.words, counts = words, words.counts
        self.base = int(counts.max(initial=0)) + 2
        self.order = np.lexsort(counts.T[::-1])
        counts = counts[self.order]
        node = np.zeros(len(counts), dtype=np.int64)
        self.children: list[np.ndarray] = []  # by level, sorted: node * base + count
        for level in range(LEVELS):
            keys, node = np.unique(node * self.base + counts[:, level], return_inverse=True)
            self.children.append(keys)
        self.first = np.searchsorted(node, np.arange(len(self.children[-1]) + 1)) if len(counts) else np.zeros(1, np.int64)

    def _child(self, level: int, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes have a child of that count, and the children."""
        keys, wanted = self.children[level], node * self.base + count
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        there = np.flatnonzero((keys[at] == wanted) & (count >= 0) & (count < self.base))
        return there, at[there]

    def _leaves(self, query: Words, who: np.ndarray, node: np.ndarray, level: int, surplus: int, deficit: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(queries, leaves, whether the vectors differ), depth first; budgets left are arguments."""
        for at in range(level, LEVELS):
            if not len(who):
                return
            count = query.counts[who, at]
            if surplus:
                there, child = self._child(at, node, count + 1)
                yield from self._leaves(query, who[there], child, at + 1, 0, deficit)
            elif deficit:
                there, child = self._child(at, node, count - 1)
                yield from self._leaves(query, who[there], child, at + 1, 0, 0)
            there, node = self._child(at, node, count)
            who = who[there]
        yield who, node, not surplus

    def search(self, query: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, word of the trie) at a distance of one edit, each from one side only."""
        if not len(self.order):
            return
        everyone = np.arange(len(query.lengths))
        for who, leaf, differ in self._leaves(query, everyone, np.zeros_like(everyone), 0, 1, 1):
            size = self.first[leaf + 1] - self.first[leaf]
            cuts = np.flatnonzero(np.diff((np.cumsum(size) - 1) // PAIRS, prepend=-1))  # a group has PAIRS pairs, and one leaf's more at most
            for a, b in zip(cuts, np.r_[cuts[1:], len(size)][: len(cuts)], strict=True):
                which, at = _spread(self.first[leaf[a:b]], size[a:b])
                i, j = who[a:b][which], self.order[at]
                found = near(query, i, self.words, j)
                i, j = i[found], j[found]
                if not differ:
                    less = np.array([query.word(x) < self.words.word(y) for x, y in zip(i, j, strict=True)], dtype=bool)
                    i, j = i[less], j[less]
                yield i, j


# -- vocabulary ------------------------------------------------------------------------


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): results of the deletions, at least 7 code points long and 2 times in all texts."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    cut = F.expr("concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    words = runs.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_TIMES)


# -- dealing out -----------------------------------------------------------------------


def _node(counts: np.ndarray) -> np.ndarray:
    """A hash of the first counts; words of two nodes with one hash share a trie, which changes nothing."""
    out = np.full(len(counts), 0x9E3779B97F4A7C15, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(counts.shape[1]):
            out = mix(out * np.uint64(0xD1B54A32D192ED03) + counts[:, k].astype(np.uint64))
    return out.view(np.int64)


def _reached(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes that a search enters, other than a word's own: rows and their hashes, a kind of step at a time."""
    everyone = np.arange(len(counts))
    for i in range(counts.shape[1]):
        more = counts.copy()
        more[:, i] += 1
        yield everyone, _node(more)
        for j in range(i + 1, counts.shape[1]):
            less = more[more[:, j] > 0]
            less[:, j] -= 1
            yield everyone[more[:, j] > 0], _node(less)


def _depth(words: DataFrame) -> tuple[int, DataFrame]:
    """The least depth at which no node holds over MOST_WORDS, else full depth; and (node, tiles) of those that do."""
    for g in range(2, LEVELS + 1):

        def nodes(batches, g=g):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"node": pa.array(_node(vectors(*_flat(batch[0]))[:, :g]))})

        sizes = words.select("code").mapInArrow(nodes, "node long").groupBy("node").count()
        large = sizes.filter(F.col("count") > MOST_WORDS)
        if large.isEmpty():
            break
    return g, large.select("node", F.ceil(F.col("count") / MOST_WORDS).cast("int").alias("tiles"))


def dealt(words: DataFrame, shards: int) -> DataFrame:
    """(shard, own, code, n): each word in its own shard, and in those that its search enters (own false), once each."""
    g, large = _depth(words)
    tiles = {r.node: r.tiles for r in large.collect()} if g == LEVELS else {}  # a row for MOST_WORDS words at most
    fields = {"shard": pa.int32(), "own": pa.bool_(), "code": pa.binary(), "n": pa.int64()}

    def place(node: np.ndarray, tile) -> np.ndarray:
        return (mix(node.view(np.uint64) + np.asarray(tile).astype(np.uint64)) % np.uint64(shards)).astype(np.int32)

    def in_tiles(rows: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        most = np.array([tiles.get(x, 1) for x in node.tolist()]) if tiles else np.ones(len(node), dtype=np.int64)
        for t in range(int(most.max(initial=0))):
            yield rows[most > t], place(node[most > t], np.full(int((most > t).sum()), t))

    def run(batches):
        for batch in batches:
            flat, lengths = _flat(batch[0])
            counts = vectors(flat, lengths)[:, :g]
            everyone, node = np.arange(len(lengths)), _node(counts)
            whole = _node(np.c_[np.add.reduceat(flat, np.cumsum(lengths) - lengths, dtype=np.int64), flat[np.cumsum(lengths) - 1]]) if tiles else node
            own = place(node, np.array([x % tiles.get(k, 1) for x, k in zip((whole & 0x7FFFFFFF).tolist(), node.tolist(), strict=True)]) if tiles else np.zeros(len(node), dtype=np.int64))
            visits = [np.c_[rows, shard] for r, k in ((everyone, node), *_reached(counts)) for rows, shard in in_tiles(r, k)]
            visits = np.unique(np.concatenate(visits), axis=0)
            visits = visits[own[visits[:, 0]] != visits[:, 1]]
            at = pa.array(np.r_[everyone, visits[:, 0]])
            columns = (np.r_[own, visits[:, 1]], np.arange(len(at)) < len(everyone), batch[0].take(at), batch[1].take(at))
            yield pa.RecordBatch.from_pydict({k: pa.array(c, t) for (k, t), c in zip(fields.items(), columns, strict=True)})

    return words.select("code", "n").mapInArrow(run, "shard int, own boolean, code binary, n long")


def pairs(words: DataFrame, shards: int | None = None) -> DataFrame:
    """(code, n, other, other_n): near words, each pair in both directions. ``words``: (code, n), code a letter a byte."""
    if shards is None:
        shards = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words.count() // TASK_WORDS))
    rows = dealt(words, shards).repartition(shards, "shard").sortWithinPartitions("shard", F.desc("own"))
    fields = {"code": pa.binary(), "n": pa.int64(), "other": pa.binary(), "other_n": pa.int64()}

    def run(batches):
        # a partition can have several shards; of each come its own words, then its visitors
        shard, own, trie = None, [], None
        for batch in batches:
            at, mine = batch[0].to_numpy(), batch[1].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (mine[1:] != mine[:-1])])
            for a, b in zip(cuts, np.r_[cuts[1:], len(at)][: len(cuts)], strict=True):
                if at[a] != shard:
                    if own:
                        yield from _asked(*_built(own), None, None)
                    shard, own, trie = at[a], [], None
                part = batch.slice(a, b - a)
                if mine[a]:
                    own.append(part)
                elif own or trie:
                    if trie is None:
                        trie, own = _built(own), []
                        yield from _asked(*trie, None, None)
                    yield from _asked(*trie, part[2], part[3].to_numpy())
        if own:
            yield from _asked(*_built(own), None, None)

    def _built(own):
        table = pa.Table.from_batches(own)
        codes = table["code"].combine_chunks()
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        return Trie(Words(*_flat(codes))), codes, table["n"].to_numpy()

    def _asked(trie, codes, times, queries, query_times):
        """Pairs of words of the trie with the queries, or with each other if none are given."""
        if queries is None:
            queries, query_times = codes, times
        for at in range(0, len(queries), 10_000):
            asked, asked_n = queries.slice(at, 10_000), query_times[at : at + 10_000]
            for i, j in trie.search(Words(*_flat(asked))):
                if len(i):
                    a, b, na, nb = asked.take(pa.array(i)), codes.take(pa.array(j)), asked_n[i], times[j]
                    columns = (pa.concat_arrays([a, b]), np.r_[na, nb], pa.concat_arrays([b, a]), np.r_[nb, na])
                    yield pa.RecordBatch.from_pydict({k: pa.array(c, t) if isinstance(c, np.ndarray) else c for (k, t), c in zip(fields.items(), columns, strict=True)})

    return rows.mapInArrow(run, "code binary, n long, other binary, other_n long")


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(code, root) from (code, form): pointers are doubled until none can be followed; each step is ten times as frequent, so rounds are few."""
    now, k = scratch.save(forms.select("code", F.col("form").alias("root")), "roots-0"), 0
    while True:
        step = now.select(F.col("code").alias("at"), F.col("root").alias("further"))
        moved = now.join(step, F.col("root") == F.col("at"), "left")
        moved = scratch.save(moved.select("code", F.coalesce("further", "root").alias("root"), F.col("at").isNotNull().alias("moved")), f"roots-{k + 1}")
        scratch.drop(f"roots-{k}")
        now, k = moved.select("code", "root"), k + 1
        if moved.filter("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the vocabulary of ``docs`` (doc_id, text).

    A null text has no words; a null doc_id is the empty text before the colon; repeated
    rows and ids count each; runs of any length are words; an empty table gives no rows.
    Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(vocabulary(docs).select(F.encode("word", "ISO-8859-1").alias("code"), "n"), "words")
    best = pairs(words).groupBy("code", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    is_form = -F.col("best.less") >= FACTOR * F.col("n")
    best = best.select("code", "n_near", F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    best = scratch.save(best, "near")
    roots = _roots(best.filter("form is not null"), scratch)
    rows = words.join(best, "code", "left").join(roots, "code", "left")
    text = lambda c: F.decode(F.col(c), "ISO-8859-1")
    return rows.select(text("code").alias("word"), text("form").alias("form"), F.coalesce(text("root"), text("code")).alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
with recursive crc as (
  select list(c order by b) as t from (select b, list_reduce(list_prepend(b, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) as r(b))
), run as (
  select coalesce(cast(doc_id as varchar), '') as id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents
), point as (
  select run, list_transform(string_split(id || ':' || run, ''), lambda x: cast(unicode(x) as bigint)) as p from run where length(run) >= 7
), hashed as (
  select run, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(p, lambda x: case when x < 128 then [x] else [192 + (x >> 6), 128 + (x & 63)] end))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as h from point, crc
), word as (
  select case when h % 31 = 0 then substr(run, 1, cast(h % length(run) as int)) || substr(run, cast(h % length(run) as int) + 2) else run end as word from hashed
), voc as (
  select word, count(*) as n from word where length(word) >= 7 group by word having count(*) >= 2
), del as (
  select word, n, i, substr(word, 1, i) || substr(word, i + 2) as d from (select word, n, unnest(range(0, length(word))) as i from voc)
), pair as (
  select a.word, b.word as other, b.n as other_n from del a join del b on a.d = b.d and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from del a join voc b on a.d = b.word
  union select b.word, a.word, a.n from del a join voc b on a.d = b.word
), best as (
  select word, count(*) as n_near, min({'less': -other_n, 'form': encode(other)}) as b from pair group by word
), near as (
  select word, n, coalesce(n_near, 0) as n_near, case when -b.less >= 10 * n then decode(b.form) end as form, case when -b.less >= 10 * n then -b.less end as form_n from voc left join best using (word)
), walk as (
  select word, word as root from near
  union all select walk.word, near.form from walk join near on walk.root = near.word where near.form is not null
)
select near.word, form, root, n, cast(n_near as bigint) as n_near, form_n from near join walk using (word) where root not in (select word from near where form is not null)
"""
