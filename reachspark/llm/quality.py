"""Quality by positive-unlabelled learning (operator 6): trusted good texts, unlabelled web text, a class prior."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pu
from .text import SPACED, chunks, mix

FOLDS, HELD_OUT = 3, 1
_BINS = 16


def _bytes(*ranges) -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    for a, b in ranges:
        table[a : b + 1] = 1
    return table


_UPPER, _LOWER, _DIGIT = _bytes((65, 90)), _bytes((97, 122), (128, 255)), _bytes((48, 57))
_MARKS, _LINES = _bytes((33, 47), (58, 64), (91, 96), (123, 126)), _bytes((10, 10))
_SYMBOLS = _bytes((35, 38), (42, 43), (60, 62), (64, 64), (92, 92), (94, 94), (124, 124), (126, 126))


def _share(part, whole) -> np.ndarray:
    """Sixteen bins, finer near zero."""
    return np.minimum(_BINS - 1, np.ceil(_BINS * np.sqrt(part / np.maximum(whole, 1)))).astype(np.int64)


def _kinds(doc: np.ndarray, h: np.ndarray, count: int) -> np.ndarray:
    """How many different hashes each document has; 44 bits tell those of one chunk apart."""
    both = np.sort(doc.astype(np.int64) << 44 | (h >> np.uint64(20)).astype(np.int64))
    return np.bincount(both[np.flatnonzero(np.r_[True, both[1:] != both[:-1]])] >> 44, minlength=count) if len(both) else np.zeros(count, np.int64)


def features(column: pa.Array) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """How the text is written, in bins, and the ends of its words."""
    size = np.uint64((1 << pu.BITS) - 1)
    for w in chunks(column, SPACED):
        rows, ids = [], []
        n, doc = np.diff(w.first), w.doc()
        count = len(n)
        h = w.hashes()
        by = lambda x: np.bincount(doc, x, minlength=count)
        length = (w.ends - w.starts).astype(np.float64)

        def of(table):
            total = np.r_[0, np.cumsum(table[w.buf])]  # noqa: B023
            return total[w.ends] - total[w.starts]  # noqa: B023

        upper, lower, digit, marks, symbols = (of(t) for t in (_UPPER, _LOWER, _DIGIT, _MARKS, _SYMBOLS))
        chars = by(length)
        same = np.zeros(len(h))
        if len(h) > 1:
            same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        distinct = _kinds(doc, h, count)
        # lines: how many, and how many repeat one of the same text
        gaps = np.zeros(len(h), dtype=bool)
        breaks = np.r_[0, np.cumsum(_LINES[w.buf])]
        if len(h):
            gaps[0] = True
            gaps[1:] = (doc[1:] != doc[:-1]) | (breaks[w.starts[1:]] > breaks[w.ends[:-1]])
        line = np.cumsum(gaps) - 1
        lines = np.bincount(doc[gaps], minlength=count)
        with np.errstate(over="ignore"):
            place = np.arange(len(h)) - np.flatnonzero(gaps)[line] if len(h) else np.empty(0, np.int64)
            sums = np.add.reduceat(mix(h + place.astype(np.uint64)), np.flatnonzero(gaps)) if len(h) else h
        shouted = ((upper >= 2) & (lower == 0)).astype(np.float64)
        marked = (symbols > 0).astype(np.float64)
        bins = [
            _share(by(upper), chars), _share(by(lower), chars), _share(by(digit), chars), _share(by(marks), chars), _share(by(symbols), chars),
            _share(by(shouted), n), _share(by(marked), n), _share(by(same), n), _share(distinct, n), _share(lines - _kinds(doc[gaps], sums, count), lines),
            np.minimum(_BINS - 1, np.log2(n + 1)).astype(np.int64), np.minimum(_BINS - 1, chars / np.maximum(n, 1)).astype(np.int64), _share(lines, n),
            _share(by((digit == length).astype(np.float64)), n), _share(by((length > 20).astype(np.float64)), n),
        ]
        for k, b in enumerate(bins):
            rows.append(np.arange(count))
            ids.append((mix((np.uint64(k * _BINS) + b.astype(np.uint64)) + np.uint64(1)) & size).astype(np.int64))
        ends = w.suffix_hashes(3)
        rows.append(doc)
        ids.append((ends & size).astype(np.int64))
        yield w.rows, np.concatenate(rows), np.concatenate(ids)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Scores use the text only. Null and empty texts are scored as texts without words;
    rows with one id are scored each by its own text; without labels the score is the
    prior 0.5. An empty table gives no rows.
    """
    model = pu.train(docs, labels, "quality", FOLDS, HELD_OUT, features, loss="sigmoid")
    return pu.digest(pu.score(docs, model, features), FOLDS, HELD_OUT)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
