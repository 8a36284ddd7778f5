"""The filter audit against counting every order by hand."""

import itertools
import re
from collections import Counter

import pytest

from reachspark.llm import audit

from .test_operators import documents

SCHEMA = "doc_id long, text string, lang string, mask string, state int, part string"


def brute(rows, labels):
    text = [(d, t or "", lang or "") for d, t, lang in rows]
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    fails = []
    for d, t, _ in text:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        f["E"] = d is not None and any(o is not None and o < d and u == t for o, u, _ in text)
        fails.append(f)
    out = []
    for part in {p for _, _, p in text}:
        mine = [(d, f) for (d, _, p), f in zip(text, fails, strict=True) if p == part]
        total = Counter()
        found = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order):
                gone = [r for r in left if r[1][x]]
                left = [r for r in left if not r[1][x]]
                total[x] += len(gone)
                redundant = sum(f[x] for _, f in mine) - len(gone)
                unique = sum(f[x] and sum(f.values()) == 1 for _, f in mine)
                found.append((part, "".join(order), k + 1, len(left), len(gone), redundant, unique, sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), x))
        out += [(*r[:-1], total[r[-1]]) for r in found]
    return sorted(out)


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


def test_every_order_on_odd_rows(spark):
    rows = [(d, t, lang) for d, t, lang, *_ in documents(5, 70)]
    rows += [(200 + i, "A " * (95 + i) + "B$c", None) for i in range(9)] + [(r[0] + 300 if r[0] is not None else None, r[1], "de") for r in rows[::4]] + [rows[3], (3, "É𝒳 " * 120, "fr")]
    labels = [(d, d % 2, d % 3 == 0) for d in range(0, 400, 3)] + [(6, 1, 0), (6, 0, 1), (None, 1, 1)]
    labels = [(d, q, int(x)) for d, q, x in labels]
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_no_rows_no_labels_and_too_many_filters(spark):
    assert audited(spark, [], [(1, 1, 1)]) == []
    rows = [(1, None, None), (2, "", None), (2, "", None), (None, "", None)]
    assert audited(spark, rows, []) == brute(rows, [])
    with pytest.raises(ValueError, match="filters"):
        audit.orders(spark.createDataFrame([], "part string, state int, n long, good long, toxic long"), "ABCDEFGHI")


def test_states_of_the_walk_are_those_of_the_sets(spark):
    cells = spark.createDataFrame([("p", m, m + 1, m % 3, m % 2) for m in (0, 1, 2, 5, 7)] + [("q", 4, 10, 1, 0)], "part string, mask int, n long, good long, toxic long")
    states = audit.subset_states(cells, 3)
    assert states.count() == 16
    for r in states.collect():
        left = [c for c in cells.collect() if c.part == r.part and c.mask & r.state == 0]
        assert (r.n, r.good, r.toxic) == (sum(c.n for c in left), sum(c.good for c in left), sum(c.toxic for c in left))
