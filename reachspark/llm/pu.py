"""Non-negative positive-unlabelled learning of text classifiers in numpy.

Only positives are trusted; the rest of the sample is unlabelled text, and a label other
than 1 is never read. With the class prior p, the risk of calling negatives positive is
estimated as that over unlabelled rows less p times that over positives, and is not let
below zero:

    p * E_pos[loss(+)]  +  max(0, E_unl[loss(-)] - p * E_pos[loss(-)])

While the second term is negative the step goes the other way, so that the model doesn't
fit its own positives by heart; steps shrink, and the model is the mean of the second half
of them, so that it doesn't depend on which way the last one went. The prior comes from the same sample: a model of one half
scores the other, and among the top scores the share of unlabelled text over that of
positives is least where nothing but positives is left (``prior_of``).

Samples are bounded by ``SAMPLE``; all rows are scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_bucket

#: At most so many positives and so many unlabelled documents are fitted on.
SAMPLE = (3000, 6000)
#: Hashed features; the weights of all of them are broadcast (2 MB).
BITS = 19
#: At most so many features get a weight, those that tell most: what the driver holds of a text is bounded by this, not by its length.
MOST_FEATURES = 6000

#: Gives, for some rows of a column at a time: which rows, the row of each feature counted from their first, the features.
Features = Callable[[pa.Array], "Iterator[tuple[range, np.ndarray, np.ndarray]]"]


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    prior: float

    def margin(self, rows: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        """Of n texts with these features; a feature counts once for each text."""
        keep = self.weights[ids] != 0
        pair = np.unique(rows[keep].astype(np.int64) << BITS | ids[keep])
        return self.bias + np.bincount(pair >> BITS, self.weights[pair & ((1 << BITS) - 1)], minlength=n)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def select(pos: np.ndarray, unl: np.ndarray, n_pos: int, n_unl: int, least_z: float = 3.0, least_lift: float = 0.0) -> np.ndarray:
    """Features whose share of texts differs surely between positives and unlabelled texts, given in how many texts each is.

    With ``least_lift``, only those that are so many times as common in positives.
    """
    p, q = (pos + 0.5) / (n_pos + 1), (unl + 0.5) / (n_unl + 1)
    both = (pos + unl + 1) / (n_pos + n_unl + 2)
    z = np.where(p >= least_lift * q, 1.0, 0.0) * np.abs(p - q) / np.sqrt(both * (1 - both) * (1 / (n_pos + 1) + 1 / (n_unl + 1)))
    best = np.argsort(-z, kind="stable")[:MOST_FEATURES]
    return np.sort(best[z[best] >= least_z])


def prior_of(pos: np.ndarray, unl: np.ndarray, sure: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among unlabelled texts, from scores of texts that the model wasn't fitted on.

    Best bin estimate: for a threshold t let q_u and q_p be the shares of unlabelled texts
    and positives that score t or more. q_u / q_p is never less than the share of
    positives, and equals it where only positives score so high. The threshold with the
    least upper confidence bound (at error ``sure``) is taken.
    """
    if not len(pos) or not len(unl):
        return 0.5
    at = np.unique(pos)
    qp = 1 - np.searchsorted(np.sort(pos), at, side="left") / len(pos)
    qu = 1 - np.searchsorted(np.sort(unl), at, side="left") / len(unl)
    slack = np.sqrt(np.log(4 / sure) / (2 * len(unl))) + np.sqrt(np.log(4 / sure) / (2 * len(pos)))
    best = np.argmin((qu + (1 + gamma) * slack) / qp)
    return float(np.clip(qu[best] / qp[best], 1e-3, 1 - 1e-3))


def fit(pos: list[np.ndarray], unl: list[np.ndarray], chosen: np.ndarray, prior: float, loss: str = "logistic", steps: int = 400, rate: float = 0.05, shrink: float = 1e-4) -> Model:
    """Linear model of least non-negative risk on the ``chosen`` features; each text is given by its distinct features.

    ``loss``: "logistic" where positives are rare; "sigmoid" where they are most of the
    text, for it is bounded, so that a prior that is a little off can't outweigh the rest.
    """
    weights = np.zeros(1 << BITS, dtype=np.float32)
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    if not pos or not unl:
        return Model(float(np.log(prior / (1 - prior))), weights, prior)
    at = np.full(1 << BITS, -1, dtype=np.int32)
    at[chosen] = np.arange(len(chosen))

    def table(texts):
        kept = [(c := at[t])[c >= 0] for t in texts]
        return np.repeat(np.arange(len(texts), dtype=np.int32), [len(c) for c in kept]), np.concatenate(kept), len(texts)

    x, u, k = table(pos), table(unl), len(chosen)
    theta = np.zeros(k + 1)
    theta[k] = np.log(prior / (1 - prior))
    m, v, mean = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)

    def margins(t):
        return theta[k] + np.bincount(t[0], theta[t[1]], minlength=t[2])

    def gradient(t, slope):
        out = np.zeros(k + 1)
        out[:k] = np.bincount(t[1], slope[t[0]], minlength=k) / t[2]
        out[k] = slope.mean()
        return out

    for step in range(1, steps + 1):
        zp, zu = margins(x), margins(u)
        sp, su = sigmoid(zp), sigmoid(zu)
        if loss == "logistic":
            up, down_p, down_u = gradient(x, sp - 1), gradient(x, sp), gradient(u, su)
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        else:
            down_p, down_u = gradient(x, sp * (1 - sp)), gradient(u, su * (1 - su))
            up = -down_p
            negative = su.mean() - prior * sp.mean()
        if negative >= 0:
            g = prior * up + down_u - prior * down_p
        else:
            g = -(down_u - prior * down_p)
        g[:k] += shrink * theta[:k]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * 0.5 * (1 + np.cos(np.pi * step / steps)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if step > steps // 2:
            mean += theta / (steps - steps // 2)
    theta = mean
    weights[chosen] = theta[:k]
    return Model(float(theta[k]), weights, prior)


def train(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, features: Features, sample: tuple[int, int] = SAMPLE, loss: str = "logistic", **choice) -> Model:
    """Learn ``label`` from rows outside the held-out fold only.

    Positives are the rows of ``labels`` that say 1; no other value of a label is used.
    Unlabelled texts are drawn from all documents of the same folds by a hash of doc_id.
    Of rows with one id one text is fitted on. Labels that are null or of unknown
    documents say nothing; without positives or documents the prior is 0.5 and nothing is
    learned.
    """
    scratch = Scratch(docs.sparkSession, "pu")
    open_ = crc_bucket("doc_id", folds) != held_out
    drawn = F.xxhash64("doc_id")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(open_ & F.col("doc_id").isNotNull())
    trusted = labels.filter(F.col(label) == 1).select(F.col("doc_id").cast("long").alias("doc_id")).filter(open_ & F.col("doc_id").isNotNull()).distinct()
    pos = trusted.join(ids, "doc_id", "left_semi").orderBy(drawn, "doc_id").limit(sample[0])
    unl = ids.distinct().orderBy(drawn, "doc_id").limit(sample[1])
    chosen = scratch.save(pos.select("doc_id", F.lit(1).alias("set")).unionByName(unl.select("doc_id", F.lit(0).alias("set"))), "sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most sum(sample) ids
    texts = texts.groupBy("doc_id", "set").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches):
        for batch in batches:
            parts = [np.unique((row.astype(np.int64) + rows.start) << BITS | ids) for rows, row, ids in features(batch[2])]
            pair = np.concatenate([*parts, np.empty(0, np.int64)])
            first = np.searchsorted(pair >> BITS, np.arange(len(batch) + 1)).astype(np.int32)
            values = pa.array((pair & ((1 << BITS) - 1)).astype(np.int32))
            yield pa.RecordBatch.from_pydict({"doc_id": batch[0], "set": batch[1], "ids": pa.ListArray.from_arrays(pa.array(first), values)})

    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    rows = scratch.save(texts.mapInArrow(run, "doc_id long, set int, ids array<int>").withColumn("half", half), "features")
    sizes = np.zeros((2, 2))
    for r in rows.groupBy("set", "half").count().collect():
        sizes[r["set"], r["half"]] = r["count"]
    counts = np.zeros((2, 2, 1 << BITS))
    found = rows.select("set", "half", F.explode("ids").alias("id")).groupBy("set", "half", "id").count().toArrow()  # 2**21 rows at most
    counts[tuple(found[c].to_numpy() for c in ("set", "half", "id"))] = found["count"].to_numpy()
    # chosen for each half alone, so that the other half's scores are those of texts not seen, and for both
    kept = [select(c[1], c[0], n[1], n[0], **choice) for c, n in ((counts[:, 0], sizes[:, 0]), (counts[:, 1], sizes[:, 1]), (counts.sum(axis=1), sizes.sum(axis=1)))]
    mask = np.zeros(1 << BITS, dtype=bool)
    mask[np.concatenate(kept)] = True
    wanted = docs.sparkSession.sparkContext.broadcast(mask)

    def thin(batches):
        for batch in batches:
            values = batch[3].flatten().to_numpy()
            keep = wanted.value[values]
            upto = np.r_[0, np.cumsum(keep)][np.r_[0, np.cumsum(batch[3].value_lengths().to_numpy(zero_copy_only=False))]].astype(np.int32)
            yield pa.RecordBatch.from_pydict({"doc_id": batch[0], "set": batch[1], "half": batch[2], "ids": pa.ListArray.from_arrays(pa.array(upto), pa.array(values[keep]))})

    # sum(sample) lists of at most 3 * MOST_FEATURES numbers of four bytes, however long the texts are
    found = rows.select("doc_id", "set", "half", "ids").mapInArrow(thin, "doc_id long, set int, half int, ids array<int>").toArrow()
    wanted.unpersist()
    scratch.drop("sample", "features")
    doc, kind, part = (found[c].to_numpy() for c in ("doc_id", "set", "half"))
    lists = [values for chunk in found["ids"].chunks for values in np.split(chunk.flatten().to_numpy(), np.cumsum(chunk.value_lengths().to_numpy(zero_copy_only=False))[:-1])]
    order = np.argsort(doc, kind="stable")

    def pick(k, halves):
        return [lists[i] for i in order[(kind[order] == k) & np.isin(part[order], halves)]]

    return fit(pick(1, [0, 1]), pick(0, [0, 1]), kept[2], _settled([(pick(1, [h]), pick(0, [h]), kept[h]) for h in (0, 1)], loss), loss)


def _settled(halves: list, loss: str, rounds: int = 8) -> float:
    """The prior at which a model of one half of the sample, fitted with it, finds no lower one in the other half.

    A model that is fitted with too large a prior ranks worse, and a worse ranking gives an
    upper bound that is less tight; so the bound falls round by round until it settles.
    """
    prior = 0.5
    for _ in range(rounds):
        found = []
        for (pos, unl, chosen), (pos2, unl2, _) in (halves, halves[::-1]):
            if pos and unl and pos2 and unl2:
                near = fit(pos, unl, chosen, prior, loss, steps=200)
                found.append(prior_of(*[np.array([near.weights[x].sum() for x in texts]) for texts in (pos2, unl2)]))
        if not found:
            return prior
        new = float(np.mean(found))
        if abs(new - prior) <= 0.02 * prior:
            return new
        prior = new
    return prior


def score(docs: DataFrame, model: Model, features: Features) -> DataFrame:
    """``doc_id, part, score`` of each row; part tells rows with one id apart."""
    from .common import PART

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores = np.empty(len(batch))
            for rows, row, ids in features(batch[2]):
                scores[rows.start : rows.stop] = sigmoid(shared.value.margin(row, ids, len(rows)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch[0], "part": batch[1], "score": pa.array(scores)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.expr(PART).alias("part"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, part int, score double")


def digest(scored: DataFrame, folds: int, held_out: int) -> DataFrame:
    return scored.select("doc_id", F.coalesce(crc_bucket("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
