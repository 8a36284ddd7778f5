"""Spelling variants against comparing all words with all."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from reachspark.llm import spelling

from .test_operators import documents


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "-", root(w), n, len(near[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 3, "clash") for r in rows], "doc_id long, text string, word string, n int, form string")
    return sorted((r.word, r.form or "-", r.root, r.n, r.n_near, r.form_n if r.form_n is not None else -1) for r in spelling.spelling_variants(docs).collect())


def corpus(seed):
    r = random.Random(seed)
    alphabet = "etaoinshrdlé×ßÿ"
    base = ["".join(r.choice(alphabet) for _ in range(r.randrange(7, 14))) for _ in range(40)]
    bag = []
    for k, w in enumerate(base):
        bag += [w] * (2 + k * 8)
        for _ in range(4):
            at, c = r.randrange(len(w)), r.choice(alphabet)
            v = r.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
            bag += [v] * r.randrange(1, 12)
            bag += [v[:2] + c + v[2:]] * 2
    bag += ["".join(r.sample("listens", 7)) for _ in range(400)] + ["Listens", "ÀListens", "short", "x" * 300, "x" * 300, "x" * 299, "x" * 299, "x" * 150 + "y" + "x" * 149] * 2
    bag += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa"] * 3 + ["abcdefg" * 5] * 30 + ["abcdefg" * 5 + "h"] * 3 + ["z" + "abcdefg" * 5] * 3
    bag += ["orchards"] * 400 + ["orchardz"] * 32 + ["orchardzz"] * 2  # a chain of forms
    r.shuffle(bag)
    rows = [(i, r.choice([" ", "1", "\n", "Ā"]).join(bag[i::40])) for i in range(40)]
    return rows + [(50, None), (51, ""), (None, " ".join(base[:5])), (3, rows[3][1]), (3, rows[4][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_all_words_with_all(spark, seed):
    rows = corpus(seed)
    expected = brute(rows)
    assert len(expected) > 200 and sum(f != "-" for _, f, *_ in expected) > 20 and any(r not in (w, f) for w, f, r, *_ in expected)
    assert found(spark, rows) == expected


def test_deep_dealing_and_tiles_of_anagrams(spark, monkeypatch):
    rows = corpus(3) + [(d, t) for d, t, *_ in documents(4, 30)]
    expected = brute(rows)
    for most in (60, 3):
        monkeypatch.setattr(spelling, "MOST_WORDS", most)
        assert found(spark, rows) == expected


def test_trie_finds_each_pair_once(monkeypatch):
    monkeypatch.setattr(spelling, "PAIRS", 7)
    r = random.Random(5)
    words = sorted({"".join(r.choice("abet") for _ in range(r.randrange(1, 6))) for _ in range(300)} | {"e" * k for k in range(30, 36)})
    column = pa.array([w.encode() for w in words], pa.binary())
    own = spelling.Words(*spelling._flat(column))
    got = Counter(tuple(sorted((words[i], words[j]))) for a, b in spelling.Trie(own).search(own) for i, j in zip(a, b, strict=True))
    assert set(got.values()) == {1} and set(got) == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    part = spelling.Words(*spelling._flat(column.slice(10, 50)))  # of a slice
    assert np.array_equal(part.counts, own.counts[10:60]) and part.word(3) == words[13].encode()
    assert not list(spelling.Trie(spelling.Words(*spelling._flat(pa.array([], pa.binary())))).search(own))


def test_empty_table_and_no_words(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, "a b c"), (2, None)]) == []
