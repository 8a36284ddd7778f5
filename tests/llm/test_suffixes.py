"""Byte-level deduplication against looking at every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachspark.llm import suffixes

from .test_operators import documents


def brute(rows):
    """Of each row: id, bytes, removed bytes, removed runs, digest of what is left."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(t) else 0))
        kept = bytes(b for b, x in zip(t, gone, strict=False) if not x)
        out.append((-1 if d is None else d, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def dropped(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], "doc_id long, text string, part string, h int, kept string")
    out = suffixes.drop_repeated_bytes(docs, **how).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out)


def corpus(seed):
    r = random.Random(seed)
    words = [f"{a}{b}é" for a in "abcdefgh" for b in "xyz"]
    text = lambda n: " ".join(r.choice(words) + str(r.randrange(1000)) for _ in range(n))
    passage = text(90)
    rows = []
    for i in range(60):
        t = text(r.randrange(5, 120))
        if i % 3 == 0:
            a = r.randrange(200)
            t = t[: r.randrange(len(t))] + passage[a : a + r.randrange(150, 350)] + t[r.randrange(len(t)) :]
        if i % 7 == 0 and rows:
            t = rows[r.randrange(len(rows))][1] or "-"
            at = r.randrange(len(t))
            t = t[:at] + r.choice(["", "!", "xx"]) + t[at + 1 :]
        rows.append((i, t))
    rows += [(100, None), (101, ""), (102, "z" * 199), (103, "y" * 200), (104, "x" * 450), (105, "ab" * 300), (106, "\0" * 210), (107, passage[:199] + "\0"), (None, passage), (5, rows[5][1]), (5, text(60)), (None, None)]
    rows += [(108, text(30) + "q" * 201 + text(3)), (109, "0123456789" * 2000)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_every_window(spark, seed):
    rows = corpus(seed)
    expected = brute(rows)
    assert sum(n for _, _, n, _, _ in expected) > 5000
    assert dropped(spark, rows) == expected


def test_small_pieces_many_batches_and_common_anchors(spark, monkeypatch):
    rows = corpus(3) + [(d, t) for d, t, *_ in documents(4, 40)]
    expected = brute(rows)
    monkeypatch.setattr(suffixes, "CHUNK", 500)
    monkeypatch.setattr(suffixes, "BUCKET", 5)
    assert dropped(spark, rows, batches=7) == expected
    monkeypatch.setattr(suffixes, "MOST_KINDS", 2)  # pieces for most anchors
    assert dropped(spark, rows) == expected


def test_pieces_hold_each_window_once():
    import pyarrow as pa

    old, suffixes.CHUNK = suffixes.CHUNK, 300
    try:
        texts = ["a" * 100, None, "b" * 299, "c" * 1000, "", "d" * 501, "e" * 499, "f" * 700]
        seen = Counter()
        for buf, cuts, row, shift in suffixes._pieces(pa.array(texts)):
            start, n, _, doc = suffixes._segments(buf, cuts)
            for a, k, d in zip(start, n, doc, strict=True):
                seen.update((row + d, a - cuts[d] + shift + x) for x in range(k))
        assert seen == Counter((i, x) for i, t in enumerate(texts) for x in range(len(t or "") - 199))
    finally:
        suffixes.CHUNK = old


def segment_rows(texts):
    """Segments (h, digest, n, seg) of some texts, each once."""
    found = {}
    for t in texts:
        buf = np.frombuffer(t, dtype=np.uint8)
        start, n, h, _ = suffixes._segments(buf, np.array([0, len(buf)]))
        for a, k, key in zip(start.tolist(), n.tolist(), suffixes.signed(h).tolist(), strict=True):
            seg = t[a : a + k + 199]
            found[key, suffixes._digest(seg)] = (key, suffixes._digest(seg), k, seg)
    return list(found.values())


def test_levels_grow_geometrically_and_are_found_again(spark):
    schema = "h long, digest binary, n int, seg binary"
    r = random.Random(7)
    passage = bytes(r.randrange(97, 123) for _ in range(400))
    batches = [[bytes(r.randrange(97, 123) for _ in range(150)) + passage[k * 10 : 260 + k * 20] + bytes(r.randrange(97, 123) for _ in range(150))] for k in range(5)]
    index = suffixes.SuffixLevels(spark, 4)
    found, ranks = set(), []
    for texts in batches:
        rows = segment_rows(texts)
        found |= {(bytes(x.digest), i) for x in index.ingest(spark.createDataFrame(rows, schema)).collect() for i in range(x.first, x.end)}
        ranks.append([rank for rank, _ in index.levels])
        # nothing but the folder is kept: the next batch goes on in an index opened from it, in a new session
        index = suffixes.SuffixLevels(spark.newSession(), path=index.path)
    assert ranks == [[0], [1], [1, 0], [2], [2, 0]]
    rows = [x for texts in batches for x in segment_rows(texts)]
    count = Counter(seg[i : i + 200] for _, _, n, seg in rows for i in range(n))
    assert found == {(digest, i) for _, digest, n, seg in rows for i in range(n) if count[seg[i : i + 200]] > 1} and found
    held = spark.read.parquet(*[f"{index.path}/{name}" for _, name in index.levels])
    for block in held.collect():  # each array is in lexicographic order
        order = np.frombuffer(block.suffixes, dtype=np.int32)
        windows = [w.tobytes() for w in suffixes._windows(bytes(block.text), np.array(block.n)).view("V200")]
        assert sorted(windows) == [windows[i] for i in order]
    assert held.agg(F.sum(F.size("h"))).first()[0] == sum(len(segment_rows(t)) for t in batches)
    with pytest.raises(ValueError, match="no index"):
        suffixes.SuffixLevels(spark, path=index.path + "-none")


def test_empty_table(spark):
    assert dropped(spark, []) == []
