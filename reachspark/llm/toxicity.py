"""Toxicity by positive-unlabelled learning (operator 1): confirmed toxic examples, unlabelled text, a class prior."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pu
from .common import Scratch, without
from .text import ALNUM_FOLDED, chunks, mix

FOLDS, HELD_OUT = 5, 0


#: Occurrences of a beginning in one text that are told apart: once, twice, three times or more.
_TIMES = 3


def features(column: pa.Array) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """Whole words and their first 4, 5 and 6 bytes, which inflected insults share, with how often they come.

    A beginning that comes once may be chance; the second and third time are features of
    their own.
    """
    for w in chunks(column, ALNUM_FOLDED):
        doc = w.doc().astype(np.int64)
        rows, ids = [], []
        for salt, h in enumerate(w.prefix_hashes((1 << 30, 4, 5, 6))):
            pair, n = np.unique(doc << 44 | (h >> np.uint64(20)).astype(np.int64), return_counts=True)
            for k in range(1, _TIMES + 1):
                often = pair[n >= k]
                rows.append(often >> 44)
                ids.append((mix(often.astype(np.uint64) & np.uint64((1 << 44) - 1) | np.uint64((salt * _TIMES + k) << 44)) >> np.uint64(64 - pu.BITS)).astype(np.int64))
        yield w.rows, np.concatenate(rows), np.concatenate(ids)


def train(docs: DataFrame, labels: DataFrame) -> pu.Model:
    return pu.train(docs, labels, "toxic", FOLDS, HELD_OUT, features, loss="logistic", least_z=4.0)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Scores use the text only. Null and empty texts get the score of a text without
    evidence; rows with one id are scored each by its own text; without labels the
    score is the prior 0.5. An empty table gives no rows.
    """
    return pu.digest(pu.score(docs, train(docs, labels), features), FOLDS, HELD_OUT)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = pu.score(docs, model, features).filter("score >= 0.5").select(F.col("doc_id").cast("long").alias("doc_id"), "part")
    return without(docs, Scratch(spark, "toxicity-stage").save(bad, "bad"))
