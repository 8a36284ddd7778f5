"""Nearest neighbours by a block matrix join of int8 tiles (operator 10).

Vectors are gathered into blocks of rows; every block of queries meets every block of
candidates once, in a grid of tiles (the stated query set against all rows). A tile
multiplies int8 matrices. With the lengths of the vectors and of what rounding took from
them, each product lies within a known distance of the true inner product, so a
candidate whose upper bound is below a query's k-th best lower bound, or below the k-th
score that its heap already has, can't be among the nearest. What survives is computed
again from the original vectors in double precision and goes through heaps of size k,
one for each query of the block; the heaps of a row of tiles are merged at the end.
The result is exact, ties included.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

K = 20
#: Rows of a block of queries and of candidates: a tile's products are 16 MB.
QUERY_ROWS, CANDIDATE_ROWS = 1024, 4096
#: Candidate blocks that one task works off after each other, with the same heaps.
RUN = 4


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the lengths of the rounded rows and of what rounding took."""
    most = np.abs(x).max(axis=1, initial=0)
    scale = np.where(most > 0, most / 127, 1.0)
    with np.errstate(invalid="ignore", over="ignore"):
        q = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.sqrt((back * back).sum(axis=1)), np.sqrt(((x - back) ** 2).sum(axis=1))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows: float32 holds sums of up to 1040 of them exactly, float64 all."""
    kind = np.float32 if a.shape[1] <= 1040 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of row pairs in double precision, summed in order of the components."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


def tile(heaps: list, query_ids, queries, q_parts, ids, rows, k: int) -> None:
    """Push one tile's candidates into the heaps of (score, -id, -tie); ids are (id, tie) of each row, of which no two are equal."""
    q, qs, qn, qe = q_parts
    c, cs, cn, ce = quantised(rows)
    near = _product(q, c).astype(np.float64) * qs[:, None] * cs[None, :]
    slack = qn[:, None] * ce[None, :] + qe[:, None] * cn[None, :] + qe[:, None] * ce[None, :]
    slack = slack * (1 + 1e-9) + 1e-12 * ((qn + qe)[:, None] * (cn + ce)[None, :]) + 1e-300
    own = query_ids[:, 1][:, None] == ids[:, 1][None, :]  # a tie is one row's
    lower = np.where(own, -np.inf, near - slack)
    floor = np.full(len(queries), -np.inf)
    if len(ids) > k:
        floor = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k]
    for i, heap in enumerate(heaps):
        if len(heap) == k:
            floor[i] = max(floor[i], heap[0][0])
    at_q, at_c = np.nonzero((near + slack >= floor[:, None]) & ~own)
    score = exact(queries[at_q], rows[at_c])
    order = np.lexsort((ids[at_c, 1], ids[at_c, 0], -score, at_q))
    at_q, score, found = at_q[order], score[order], -ids[at_c][order]
    first = np.searchsorted(at_q, np.arange(len(queries) + 1))
    for i in np.flatnonzero(np.diff(first)):
        a, b = first[i], min(first[i + 1], first[i] + k)
        for entry in zip(score[a:b].tolist(), *found[a:b].T.tolist(), strict=True):
            if len(heaps[i]) < k:
                heapq.heappush(heaps[i], entry)
            elif entry > heaps[i][0]:
                heapq.heapreplace(heaps[i], entry)
            else:
                break


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, tie, dim, vector) that take part: no nulls, all finite, not zero. Each row has a ``tie`` of its own, by which rows with one id are told apart; write it before it is used twice."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).filter("vec_id is not null and vector is not null")
    rows = rows.filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    return rows.select("vec_id", F.monotonically_increasing_id().alias("tie"), F.size("vector").alias("dim"), "vector")


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """(dim, block, ids, data): some ``most`` rows of one dimension each; the matrix is 8 bytes a component.

    How many blocks there are depends on the rows alone, not on how they are partitioned.
    """
    parts = max(1, -(-rows.count() // most))

    def run(batches):
        key, held = None, []

        def made():
            ids, data = (np.concatenate(x) for x in zip(*held, strict=True))
            for at in range(0, len(ids), 2 * most):  # a block is rarely much over its mean
                yield pa.RecordBatch.from_pydict({"dim": pa.array([key[0]], pa.int32()), "ids": pa.array([ids[at : at + 2 * most].tobytes()], pa.binary()), "data": pa.array([data[at : at + 2 * most].tobytes()], pa.binary())})

        for batch in batches:
            both = np.stack([batch[0].to_numpy(), batch[1].to_numpy()], axis=1)
            cuts = np.flatnonzero(np.r_[True, (both[1:] != both[:-1]).any(axis=1), True]) if len(both) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and key != tuple(both[a]):
                    yield from made()
                    held = []
                key = tuple(both[a].tolist())
                ids = np.stack([batch[2].slice(a, b - a).to_numpy(), batch[3].slice(a, b - a).to_numpy()], axis=1)
                held.append((ids, batch[4].slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)))
        if held:
            yield from made()

    dealt = rows.select("dim", F.pmod(F.xxhash64("vec_id", "tie"), F.lit(parts)).cast("int").alias("part"), "vec_id", "tie", "vector").repartition(parts, "dim", "part").sortWithinPartitions("dim", "part")
    return dealt.mapInArrow(run, "dim int, ids binary, data binary").withColumn("block", F.monotonically_increasing_id())


def nearest(vectors: DataFrame, every: int = 20, k: int = K, query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query (ids divisible by ``every``) by inner product.

    Ties go to the smaller id. Null vectors and vectors that are zero or hold null or
    non-finite components take no part, nor do rows without an id; vectors of different
    dimension are not compared; rows with one id are rows like others, as candidates (of
    each other, too) and as queries, each with ranks of its own; an empty table, or one
    vector, gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "neighbours")
    rows = scratch.save(usable(vectors, id_col, vector_col), "rows")
    queries = scratch.save(_blocks(rows.filter(F.col("vec_id") % every == 0), query_rows), "queries")
    candidates = scratch.save(_blocks(rows, candidate_rows), "candidates")
    lanes = max(1, -(-candidates.count() // RUN))
    # each block of candidates goes to one lane, each block of queries to all lanes of its dimension
    lane = candidates.select("dim", F.pmod(F.hash("block"), F.lit(lanes)).alias("lane"), F.lit(1).alias("kind"), "block", "ids", "data")
    grid = lane.join(F.broadcast(queries.select("dim", F.col("block").alias("against"))), "dim")  # block numbers: one for query_rows queries
    mine = queries.join(F.broadcast(lane.select("dim", "lane").distinct()), "dim").select("dim", "lane", F.lit(0).alias("kind"), "block", "ids", "data", F.col("block").alias("against"))
    tiles = grid.select("dim", "lane", "kind", "block", "ids", "data", "against").unionByName(mine)
    tasks = min(10_000, max(1, lanes * max(1, queries.count())))

    def run(batches):
        schema = ["query_id", "query_tie", "vec_id", "score"]
        key, query = None, None

        def out():
            ids, _, _, heaps = query
            rows = [(*q, -c, s) for q, heap in zip(ids.tolist(), heaps, strict=True) for s, c, _ in heap]
            if rows:
                yield pa.RecordBatch.from_pydict({n: pa.array(x, pa.float64() if n == "score" else pa.int64()) for n, x in zip(schema, zip(*rows, strict=True), strict=True)})

        for batch in batches:
            for dim, lane, kind, against, ids, data in zip(*(batch[c] for c in ("dim", "lane", "kind", "against", "ids", "data")), strict=True):
                dim, now = dim.as_py(), (dim.as_py(), lane.as_py(), against.as_py())
                ids, data = np.frombuffer(ids.as_py(), np.int64).reshape(-1, 2), np.frombuffer(data.as_py(), np.float64).reshape(-1, dim)
                if kind.as_py() == 0:
                    if query is not None:
                        yield from out()
                    key, query = now, (ids, data, quantised(data), [[] for _ in ids])
                elif now == key:
                    tile(query[3], query[0], query[1], query[2], ids, data, k)
        if query is not None:
            yield from out()

    dealt = tiles.repartition(tasks, "dim", "lane", "against").sortWithinPartitions("dim", "lane", "against", "kind", "block")
    found = dealt.mapInArrow(run, "query_id long, query_tie long, vec_id long, score double")
    order = W.partitionBy("query_id", "query_tie").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = f"""
with usable as (
  select row_number() over () as r, vec_id, cast(embedding as double[]) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
)
select query_id, cast(rank as int) as rank, vec_id, score from (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) as score, row_number() over (partition by q.r order by list_inner_product(q.v, c.v) desc, c.vec_id) as rank
  from usable q join usable c on q.vec_id % 20 = 0 and q.r <> c.r and len(q.v) = len(c.v)
) where rank <= {K}
"""
