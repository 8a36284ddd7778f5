"""Operators against brute force, and on nulls, empties, long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from reachspark.llm import chat, decontaminate, licenses, mixing, neighbours, pu, quality, simhash, substring, text, toxicity, warc
from reachspark.llm.common import Scratch, components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=1, n=60):
    """Random words of a small vocabulary, with copies, near copies, shared passages and odd texts."""
    r = random.Random(seed)
    word = lambda: r.choice(["alpha", "Beta", "gamma", "é", "delta,", "x1", "THE", "of"]) + str(r.randrange(40))
    passage = [word() for _ in range(30)]
    rows = []
    for i in range(n):
        words = [word() for _ in range(r.randrange(1, 60))]
        if i % 5 == 0:
            at = r.randrange(len(words))
            words[at:at] = passage[: r.randrange(10, 30)]
        if i % 7 == 0 and rows:
            words = list(rows[r.randrange(len(rows))])
            if i % 2 and len(words) > 20:
                words[3] = "changed"
        rows.append(words)
    out = [(i, r.choice([" ", "\n", "\t "]).join(w), "en", f"src{i % 3}", 0) for i, w in enumerate(rows)]
    return out + [(n, None, None, None, None), (n + 1, "", "en", "src0", 0), (n + 2, "   ", "en", None, 3), (n + 3, "word " * 20000, "en", "src0", 100000), (None, "no id here", "en", "src1", 10)]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def folded(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# -- words ---------------------------------------------------------------------------


def test_words_and_hashes_across_documents_and_pieces(monkeypatch):
    monkeypatch.setattr(text, "CHUNK", 50)
    monkeypatch.setattr(text, "PIECE", 16)
    texts = ["ab", "cd ef", "", None, "gh", "\n gh\tij ", "a-b 1é_", "cd ef", "longer words than a piece: abcdefghijklmnopqrstuvwxyz"]
    for table, pattern, fold in ((text.SPACED, r"[^\x20\x09-\x0D]+", False), (text.ALNUM_FOLDED, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        got, hashes = [], {}
        for w in text.chunks(pa.array(texts), table):
            h = w.hashes()
            for i in range(len(w.rows)):
                words = [w.text(k, k + 1).decode() for k in range(w.first[i], w.first[i + 1])]
                got.append(words)
                for word, x in zip(words, h[w.first[i] : w.first[i + 1]], strict=True):
                    assert hashes.setdefault(word, x) == x
        assert got == [re.findall(pattern, folded(t) if fold else t or "") for t in texts]
        assert len(set(hashes.values())) == len(hashes)


def test_sliding_min_and_grams():
    x = np.random.default_rng(1).integers(0, 1 << 63, 100).astype(np.uint64)
    for n in (1, 2, 9, 13, 100):
        assert text.sliding_min(x, n).tolist() == [x[i : i + n].min() for i in range(101 - n)]
    y = np.concatenate([x[:20], x[:20]])
    g = text.grams(y, 5)
    assert g[0] == g[20] and g[3] == g[23] and g[0] != g[1]
    assert len(text.grams(x[:3], 5)) == 0


# -- 8 -------------------------------------------------------------------------------


def brute_simhash(rows):
    fp = []
    for _, t in rows:
        w = spaced(folded(t))
        shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fp.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fp[i] ^ fp[j]).bit_count() <= 4:
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d if d is not None else -1, f"{fp[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows))


def test_simhash_matches_brute_force(spark):
    rows = documents()
    rows += [rows[3], rows[3]]
    got = [(r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got) == brute_simhash([r[:2] for r in rows])


def test_simhash_tiles_find_what_one_place_finds(spark):
    r = random.Random(3)
    base = r.getrandbits(64)
    fps = {base} | {base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(300)} | {r.getrandbits(64) for _ in range(50)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    df = spark.createDataFrame(signed, "fp long")
    found = []
    for most in (20_000, 40):
        scratch = Scratch(spark, "t")
        found.append({(c.node, c.root) for c in components(scratch, simhash.links(scratch, df, most=most)).collect()})
    assert found[0] == found[1]
    linked = {n for n, _ in found[0]}
    for (a,), (b,) in itertools.combinations(signed, 2):
        if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4:
            assert a in linked and b in linked and dict(found[0])[a] == dict(found[0])[b]


def test_simhash_forest_of_a_large_place():
    r = np.random.default_rng(5)
    fp = np.unique(np.uint64(12345) ^ (np.uint64(1) << r.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 200).astype(np.uint64)))
    a, b = simhash.forest(fp, 4)
    assert len(a) == len(fp) - 1 and (np.bitwise_count(a ^ b) <= 4).all()


def brute_near_copies(rows):
    """Which rows name the groups of texts whose five-word shingles are 0.8 alike, by all pairs; a null id comes last."""

    def shingles(t):
        w = spaced(folded(t)) if t else []
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = sorted((top(i), top(j)), key=lambda x: (rows[x][0] is None, rows[x][0] or 0))
            root[b] = a
    return [i for i in range(len(rows)) if top(i) == i]


def test_near_copies_match_exact_jaccard(spark):
    r = random.Random(5)
    rows = [(i, t, "en", "s", 0) for i, (_, t, *_) in enumerate(documents(6, 40)) if t]
    long = [" ".join(f"w{r.randrange(5000)}" for _ in range(200)) for _ in range(12)]
    for k, t in enumerate(long):  # some 0.8 to 0.95 alike, so mostly beyond 4 bits
        rows.append((1000 + k, t, "en", "s", 0))
        for j in range(3):
            w = t.split()
            for at in r.sample(range(200), j + 1 + k % 3):
                w[at] = "changed"
            rows.append((2000 + 10 * k + j, " ".join(w), "en", "s", 0))
    rows += [(5000, "", "en", "s", 0), (5001, None, "en", "s", 0), (5002, "a b", "en", "s", 0), (5003, "A  b", "en", "s", 0)]

    expected = {rows[i][0] for i in brute_near_copies([x[:2] for x in rows])}
    docs = frame(spark, rows).repartition(3)
    assert {x.doc_id for x in simhash.stage(spark, docs, "").collect()} == expected
    assert expected < {x.doc_id for x in simhash.near_duplicates(docs).collect() if x.doc_id == x.component_id}


def test_simhashes_connect_near_copies(spark):
    r = random.Random(15)
    rows = []
    for k in range(8):
        w = [f"w{r.randrange(5000)}" for _ in range(300)]
        rows += [(10 * k + j, " ".join(w[j:]), "en", "s", 0) for j in range(4)]  # some 0.99 alike
    scratch = simhash.Scratch(spark, "simhash-test")
    texts = scratch.save(simhash.shingle_sets(frame(spark, rows)).select("doc_id", "fp", "n", "sim"), "texts")
    sims = {x.fp: x.sim & (2**64 - 1) for x in texts.collect()}
    pairs = scratch.save(simhash.simhash_pairs(scratch, texts.select("fp", "n", "sim")).select("a", "b"), "pairs")
    close = [(a, b) for a, b in itertools.combinations(sorted(sims), 2) if (sims[a] ^ sims[b]).bit_count() <= 4]
    assert close and all((sims[x.a] ^ sims[x.b]).bit_count() <= 4 for x in pairs.collect())
    found = {c.node: c.root for c in components(scratch, pairs).collect()}
    assert all(found[a] == found[b] for a, b in close)
    ids = {x.fp: x.doc_id for x in texts.collect()}
    assert any(found.get(a) == found.get(b, 0) and ids[a] // 10 == ids[b] // 10 for a, b in close)


def test_jaccard_forest_connects_what_all_pairs_connect():
    r = random.Random(9)
    base = [r.sample(range(10**6), 40) for _ in range(6)]
    sets = [set(x) for b in base for x in [b] + [[y if r.random() > 0.15 else r.randrange(10**6) for y in b] for _ in range(25)]] + [{1}, {1}, {2}]
    flat = np.concatenate([np.array(sorted(x), dtype=np.int64) for x in sets])
    first = np.r_[0, np.cumsum([len(x) for x in sets])]

    def groups(pairs, start):
        name = list(start)
        for i, j in pairs:
            name = [name[i] if x == name[j] else x for x in name]
        return {frozenset(k for k, x in enumerate(name) if x == y) for y in name}

    pairs = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for root in (np.arange(len(sets)), np.arange(len(sets)) // 2 * 2):
        a, b = simhash.jaccard_forest(first, flat, root, 0.8)
        assert {(min(x), max(x)) for x in zip(a.tolist(), b.tolist(), strict=True)} <= set(pairs) and 0 < len(a) < len(sets)
        assert groups(zip(a, b, strict=True), root) == groups(pairs, root)


@pytest.mark.parametrize("most", [simhash.PLACE_SHINGLES, 300])
def test_near_copies_in_places_worked_off_in_tiles(spark, most):
    r = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):  # most pairs are between 0.6 and 0.9 alike
        w = list(base)
        for at in r.sample(range(120), r.choice([0, 1, 2, 3, 4, 5])):
            w[at] = f"x{r.randrange(12)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    named = {x.doc_id for x in simhash.near_copies(frame(spark, rows).repartition(3), most=most).collect() if x.kept}
    assert named == {rows[i][0] for i in brute_near_copies([x[:2] for x in rows])}


def test_near_copies_under_one_id_or_none(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in [(1, a), (1, b), (0, a), (7, c), (7, c), (8, c), (None, d), (None, d), (None, a), (9, c + " more")]]).repartition(3)
    assert sorted(((x.doc_id, x.text) for x in simhash.stage(spark, docs, "").collect()), key=str) == sorted([(1, b), (0, a), (7, c), (None, d)], key=str)


# -- 7 -------------------------------------------------------------------------------


def brute_repeats(rows):
    own = {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = spaced(t)
        for i in range(len(w) - 12):
            own.setdefault(tuple(w[i : i + 13]), d)
    out = []
    for d, t in rows:
        w = spaced(t)
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if d is not None and own[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d if d is not None else -1, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_substring_matches_brute_force(spark, batches):
    rows = documents(2)
    rows += [rows[10], (rows[10][0], "another text of the same id " * 4, "en", "s", 1)]
    got = substring.drop_repeated(frame(spark, rows), batches, digest=True).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats([r[:2] for r in rows])


def thue_morse(n):
    """A text of 2**n letters and its complement, which every polynomial modulo 2**64 takes for equal from n = 10 on."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [6, 10, 11])
def test_long_words_of_equal_polynomials_are_told_apart(spark, n):
    a, b = thue_morse(n)
    h = [int(w.hashes()[0]) for t in (a, b) for w in text.chunks(pa.array([t]), text.SPACED)]
    assert h[0] != h[1]
    said = " ".join(f"w{i}" for i in range(12))
    got = substring.drop_repeated(frame(spark, [(1, f"{said} {a}", "en", "s", 1), (2, f"{said} {b}", "en", "s", 1)]), 1, digest=True).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0}
    assert sorted(r.doc_id for r in simhash.stage(spark, frame(spark, [(1, a, "en", "s", 1), (2, b, "en", "s", 1), (3, a, "en", "s", 1)]), "").collect()) == [1, 2]


def test_batches_of_ids_with_one_far_off(spark):
    rows = [(i if i < 99 else 10**15, " ".join(f"w{j}" for j in range(i % 7, 30)), "en", "s", 1) for i in range(100)]
    got = substring.drop_repeated(frame(spark, rows), 3, digest=True).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats([r[:2] for r in rows])


def test_near_copies_with_a_map_beside_them(spark):
    rows = [(1, "a b c d e f", {"k": 1}), (1, "a b c d e f", {"k": 1}), (2, "g h i", None), (2, "g h i", {"k": 2})]
    got = simhash.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>"), "").collect()
    assert sorted(r.doc_id for r in got) == [1, 2]


def test_substring_index_compacts_and_still_finds(spark):
    rows = documents(4, 40)
    df = frame(spark, rows)
    spans = substring.repeated_spans(df, batches=5, fanout=1)
    removed = {r.doc_id: sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)) for r in spans.collect()}
    assert removed == {d: n for d, _, n, _ in brute_repeats([r[:2] for r in rows]) if n}


def test_substring_index_needs_nothing_but_the_batches(spark):
    said = " ".join(f"w{i}" for i in range(20))
    index = substring.FingerprintIndex(spark)
    first = index.ingest(frame(spark, [(1, said, "en", "s", 1), (3, "before " + said + " after", "en", "s", 1)])).collect()
    # a passage's ends, too, are told from the windows of earlier batches
    second = index.ingest(frame(spark, [(2, said, "en", "s", 1), (4, "x " * 9 + " ".join(said.split()[3:18]) + " y" * 9, "en", "s", 1), (None, said, "en", "s", 1)])).collect()
    index.close()
    assert [(r.doc_id, list(r.spans)) for r in first] == [(3, [1, 21])]
    assert sorted((r.doc_id, list(r.spans)) for r in second) == [(2, [0, 20]), (4, [9, 24])]


def test_substring_sql_is_the_brute_force(spark):
    import duckdb

    rows = documents(6)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r[:2] for r in rows])
    got = sorted((-1 if d is None else d, n, g, k) for d, n, g, k in con.execute(substring.OP7_SQL).fetchall())
    assert got == brute_repeats([r[:2] for r in rows])


def test_substring_keeps_other_columns(spark):
    rows = [(1, "a b c d e f g h i j k l m n", 7, "x"), (2, "z a b c d e f g h i j k l m n", 8, "y"), (3, "own   words", 9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int, whole string")
    got = {r.doc_id: r for r in substring.drop_repeated(df, 1).collect()}
    assert got[2].text == "z" and got[2].spans == 8 and got[2].whole == "y"
    assert got[3].text == "own   words" and got[1].text == rows[0][1]


# -- 4 -------------------------------------------------------------------------------


def brute_contamination(docs, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for item, t in items:
        w = re.findall(pattern, folded(t))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for d, t in docs:
        w = re.findall(pattern, folded(t))
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit[i : i + n] = [True] * n
                    found |= windows[tuple(w[i : i + n])]
        names = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((d if d is not None else -1, len(w), sum(hit), len([i for i in found if i is not None]), hashlib.sha256(names.encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out)


def test_contamination_matches_brute_force(spark):
    docs = documents(6)
    words = spaced(docs[5][1])
    items = [(1, " ".join(words[:25])), (2, "alpha1 beta2"), (10, words[0]), (3, None), (4, "... !"), (1, " ".join(words[2:16])), (None, " ".join(words[1:3])), (7, " ".join(spaced(docs[0][1])))]
    got = decontaminate.contamination(frame(spark, docs + [docs[5]]), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got)
    assert got == brute_contamination([r[:2] for r in docs + [docs[5]]], items)


def test_contamination_without_items_or_documents(spark):
    docs, items = frame(spark, documents(1, 5)), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, items).filter("contaminated or n_hit > 0").count() == 0
    assert decontaminate.contamination(frame(spark, []), items).count() == 0


# -- 1 and 6 -------------------------------------------------------------------------


def labelled(seed, n=400, share=0.3):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = r.random() < share
        words = [r.choice("the of and cat dog runs over low high tree".split()) + str(r.randrange(9)) for _ in range(r.randrange(20, 60))]
        if bad:
            for k in range(3):
                words.insert(r.randrange(len(words)), "vile" + r.choice(["ness", "ly", "st", ""]))
        rows.append((i, " ".join(words), "en", "s", 0))
        if i % 2:
            labels.append((i, int(bad)))
    return rows, labels, {i: v for i, v in labels}


def test_toxicity_on_the_held_out_fold(spark):
    rows, labels, truth = labelled(8)
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (None, "vileness vile", None, None, None), rows[0]]
    df = toxicity.toxicity(frame(spark, rows), spark.createDataFrame(labels + [(5000, 1), (None, 1), (7, None)], "doc_id long, toxic int"))
    got = df.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held) and len(held) > 20
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_labels_of_the_held_out_fold_are_not_read(spark):
    rows, labels, _ = labelled(9, 120)
    other = [(d, 1 - y) if zlib.crc32(str(d).encode()) % 5 == 0 else (d, y) for d, y in labels]
    scores = [{r.doc_id: r.score for r in toxicity.toxicity(frame(spark, rows), spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, other)]
    assert scores[0] == scores[1]


def test_toxicity_without_labels_and_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(frame(spark, documents(1, 4)), none).collect()} == {0.5}
    assert toxicity.toxicity(frame(spark, []), none).count() == 0


def test_quality_on_real_rows(spark):
    df = quality.op6_quality(spark, "/root/testdata/sf0.01")
    truth = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in df.collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)


def words_of(text, folded):
    pattern = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+" if folded else rb"[^\x20\x09-\x0D]+"
    raw = (text or "").encode()
    return re.findall(pattern, re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw) if folded else raw)


def test_toxicity_scores_match_plain_python(spark):
    rows, labels, _ = labelled(21, 400)
    rows += [(5000, None, "x", None, 1), (5001, "", None, None, None), (5002, "vile " * 4000 + "tree", "en", "s", 1), (5002, "Vileness! vileNESS, vilely\nvile-st", "en", "s", 2), (None, "cat", None, None, None)]
    docs = frame(spark, rows).withColumnRenamed("lang", "score").withColumnRenamed("source", "part")  # names of ours
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert (model.weights != 0).sum() > 3 and 0.15 < model.prior < 0.6
    expected = []
    for d, t, *_ in rows:
        words, total = words_of(t, True), set()
        for cut in (1 << 30, 4, 5, 6):
            often = {}
            for w in words:
                often[w[:cut]] = often.get(w[:cut], 0) + 1
            for w, n in often.items():
                total |= brute_ids(w, min(n, 3), cut)
        z = model.bias + sum(float(model.weights[i]) for i in total)
        expected.append((-1 if d is None else d, 1 / (1 + np.exp(-z))))
    got = [(-1 if r.doc_id is None else r.doc_id, r.score) for r in pu.score(docs, model, toxicity.features).collect()]
    assert [d for d, _ in sorted(got)] == [d for d, _ in sorted(expected)]
    assert np.allclose([s for _, s in sorted(got)], [s for _, s in sorted(expected)], atol=1e-6)


def poly(data, base):
    """The word hash by its definition: a polynomial of the bytes modulo 2**64, mixed."""
    power, total = 1, 0
    for b in data:
        total = (total + b * power) % (1 << 64)
        power = power * (base | 1) % (1 << 64)
    return int(text.mix(np.array([(total + len(data) * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0])


def brute_ids(word, times, cut):
    salt = {1 << 30: 0, 4: 1, 5: 2, 6: 3}[cut]
    h = poly(word[:cut], 0x7C3D9A6F1B5E8A2D) >> 20
    return {int(text.mix(np.array([h | (salt * 3 + k) << 44], np.uint64))[0]) >> (64 - pu.BITS) for k in range(1, times + 1)}


def test_quality_scores_match_plain_python(spark):
    rows = [(i, t, lang, s, n) for i, t, lang, s, n in documents(31, 60)]
    rows += [(900, None, None, None, None), (901, "", None, None, None), (902, "word " * 30000, "en", "s", 1), (903, "!!! ??? ###", "en", "s", 1), (904, "SHOUT shout\nSHOUT shout\nline", "en", "s", 1), rows[3], (rows[3][0], "another text 12", "en", "s", 1)]
    docs = frame(spark, rows).withColumnRenamed("lang", "set").withColumnRenamed("source", "ids")  # names of ours
    labels = spark.createDataFrame([(r[0], int(i % 4 != 0)) for i, r in enumerate(rows) if r[0] is not None] + [(None, 1), (77777, 1)], "doc_id long, quality int")
    out = quality.quality(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert quality.quality(docs.limit(0), labels).count() == 0
    model = pu.train(docs, labels, "quality", quality.FOLDS, quality.HELD_OUT, quality.features, loss="sigmoid")
    size = (1 << pu.BITS) - 1
    bins = lambda part, whole: min(15, int(np.ceil(16 * np.sqrt(part / max(whole, 1)))))
    expected = []
    for d, t, *_ in rows:
        words, raw = words_of(t, False), (t or "").encode()
        n, chars = len(words), sum(map(len, words))
        count = lambda *ranges: sum(any(a <= b <= z for a, z in ranges) for w in words for b in w)  # noqa: B023, E731
        lines = [tuple(x) for x in (words_of(line.decode("utf-8", "replace"), False) for line in raw.split(b"\n")) if x]
        symbol = [(35, 38), (42, 43), (60, 62), (64, 64), (92, 92), (94, 94), (124, 124), (126, 126)]
        within = lambda w, *ranges: sum(any(a <= b <= z for a, z in ranges) for b in w)
        low = [(97, 122), (128, 255)]
        values = [
            bins(count((65, 90)), chars), bins(count(*low), chars), bins(count((48, 57)), chars), bins(count((33, 47), (58, 64), (91, 96), (123, 126)), chars), bins(count(*symbol), chars),
            bins(sum(within(w, (65, 90)) >= 2 and not within(w, *low) for w in words), n), bins(sum(within(w, *symbol) > 0 for w in words), n), bins(sum(a == b for a, b in zip(words, words[1:])), n),
            bins(len(set(words)), n), bins(len(lines) - len(set(lines)), len(lines)), min(15, int(np.log2(n + 1))), min(15, int(chars / max(n, 1))), bins(len(lines), n),
            bins(sum(within(w, (48, 57)) == len(w) for w in words), n), bins(sum(len(w) > 20 for w in words), n),
        ]
        found = {int(text.mix(np.array([k * 16 + b + 1], np.uint64))[0]) & size for k, b in enumerate(values)} | {poly(w[-3:], 0x7C3D9A6F1B5E8A2D) & size for w in words}
        expected.append((-1 if d is None else d, 1 / (1 + np.exp(-(model.bias + sum(float(model.weights[i]) for i in found))))))
    got = [(-1 if r.doc_id is None else r.doc_id, r.score) for r in pu.score(docs, model, quality.features).collect()]
    assert np.allclose([s for _, s in sorted(got)], [s for _, s in sorted(expected)], atol=1e-6)


def test_prior_is_found_without_negatives():
    r = np.random.default_rng(1)
    for share in (0.1, 0.5, 0.85):
        unlabelled = np.r_[r.normal(4, 1, int(3000 * share)), r.normal(0, 1, int(3000 * (1 - share)))]
        assert abs(pu.prior_of(r.normal(4, 1, 1500), unlabelled) - share) < 0.05
    assert pu.prior_of(np.empty(0), np.ones(3)) == 0.5


def test_no_label_but_one_is_read(spark):
    rows, labels, _ = labelled(22, 120)
    scores = [{r.doc_id: r.score for r in toxicity.toxicity(frame(spark, rows), spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, [x for x in labels if x[1]])]
    assert scores[0] == scores[1]


def test_non_negative_risk_learns_from_positives_and_unlabelled():
    r = np.random.default_rng(0)
    good = [np.array([1, *r.integers(10, 40, 3)]) for _ in range(200)]
    bad = [np.array([2, *r.integers(10, 40, 3)]) for _ in range(200)]
    for loss in ("logistic", "sigmoid"):
        pos, unl = [np.unique(x) for x in good[:100]], [np.unique(x) for x in good[100:] + bad[:100]]
        texts_with = lambda xs: np.bincount(np.concatenate(xs), minlength=1 << pu.BITS)
        chosen = pu.select(texts_with(pos), texts_with(unl), len(pos), len(unl))
        assert {1, 2} <= set(chosen.tolist())
        m = pu.fit(pos, unl, chosen, 0.5, loss=loss)
        score = lambda xs: np.array([pu.sigmoid(m.bias + m.weights[np.unique(x)].sum()) for x in xs])  # noqa: B023, E731
        assert (score(good) >= 0.5).mean() > 0.95 and (score(bad) < 0.5).mean() > 0.95


# -- 2 -------------------------------------------------------------------------------


def test_mixing_keeps_all_rows_within_a_block_of_the_targets(spark):
    weights = {"a": 5, "b": 1, "c": 1, "d": 1, "e": 2}
    sizes = {"a": 160, "b": 41, "c": 33, "d": 32, "e": 70}
    rows = [(i, s) for s, n in sizes.items() for i in range(len(s) * 1000, len(s) * 1000 + n)]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("whole", F.lit(1))
    got = mixing.mixed(df, spark.createDataFrame(list(weights.items()), "source string, w int"), block=4).collect()
    assert len(got) == len(rows) and got[0].whole == 1
    slots = {}
    for r in got:
        assert slots.setdefault(r.mix_slot, (r.source, r.mix_block)) == (r.source, r.mix_block)
    assert sorted(slots) == list(range(sum(-(-n // 4) for n in sizes.values())))
    dealt, total = dict.fromkeys(weights, 0), sum(weights.values())
    rounds = min(-(-sizes[s] // 4) // weights[s] for s in weights)
    for slot in range(rounds * total):
        dealt[slots[slot][0]] += 1
        for s, w in weights.items():
            assert abs(dealt[s] - w * (slot + 1) / total) < 1
    assert len({(r.source, r.mix_position) for r in got}) == len(rows)


def test_mixing_of_nulls_repeats_and_nothing(spark):
    df = frame(spark, documents(1, 10) * 2)
    got = mixing.mixed(df).collect()
    assert len(got) == df.count() and {r.source for r in got} == {None, "src0", "src1", "src2"}
    assert mixing.mixed(frame(spark, [])).count() == 0


# -- 3 -------------------------------------------------------------------------------


def test_weights_named_twice_and_weights_that_are_none(spark):
    df = frame(spark, [(i, "t", "en", f"s{i % 2}", 0) for i in range(100)])
    weights = lambda *rows: spark.createDataFrame(rows, "source string, w double")
    one, two = mixing.mixed(df, weights(("s0", 1.0), ("s0", 2.0), ("s1", 1.0), ("x", 5.0)), block=4).collect(), mixing.mixed(df, weights(("s0", 3.0), ("s1", 1.0)), block=4).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and len({r.doc_id for r in one}) == len(one) == 100
    for bad in (0.0, -1.0, 1.5, None):
        with pytest.raises(ValueError, match="integers of 1 or more"):
            mixing.mixed(df, weights(("s0", bad), ("s1", 1.0)))


def test_warc_round_trip_rolls_files_and_is_deterministic(spark):
    rows = [(i, f"http://h/{i}", "page %d " % (i % 7) * (i % 5)) for i in range(50)] + [(100, None, None), (101, "http://a%b\r\n", "é\r\n\r\nx"), (None, "u", "page"), (102, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifests = []
    for parts in (1, 5):
        path = Scratch(spark, "w").path
        m = warc.write(df.repartition(parts), path, shard_bytes=6000, roll_bytes=1000).collect()
        manifests.append(sorted(tuple(r) for r in m))
        got = {r.page_id: r for r in warc.read(spark, path).collect()}
        assert len(got) == len(rows)
    assert manifests[0] == manifests[1] and len(manifests[0]) > 3
    last = {}
    for i, _, t in rows:
        if i is not None:
            last[t or ""] = max(i, last.get(t or "", -1))
    for i, u, t in rows:
        payload = (t or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.url) == (len(payload), warc.sha1_base32(payload), u or "")
        keeper = last.get(t or "", i)
        if i is None or keeper == i:
            assert r.record_type == "response" and bytes(r.payload) == payload and r.refers_to is None
        else:
            assert r.record_type == "revisit" and r.refers_to == keeper and r.payload is None


def test_warc_decides_revisits_by_payload_not_by_id(spark):
    rows = [(5, "a", "A"), (5, "b", "B"), (9, "c", "A"), (3, "d", "A"), (3, "e", "B"), (3, "f", "C"), (3, "g", "B")]
    path = Scratch(spark, "w").path
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = sorted((r.page_id, r.url, r.record_type, r.refers_to, r.payload_digest, None if r.payload is None else bytes(r.payload).decode()) for r in warc.read(spark, path).collect())
    keeper = {"A": 9, "B": 5, "C": 3}
    assert got == sorted((i, u, "response" if keeper[t] == i else "revisit", None if keeper[t] == i else keeper[t], warc.sha1_base32(t.encode()), t if keeper[t] == i else None) for i, u, t in rows)


def test_warc_shards_split_whatever_the_ids(spark, monkeypatch):
    # an id far off, null ids and equal rows of one id, each of which would fill an id range of its own
    rows = [(i, f"http://h/{i}", "x" * 500 + str(i)) for i in range(40)] + [(10**15, "far", "y" * 500)] + [(None, f"n{i}", "z" * 500 + str(i)) for i in range(40)] + [(7, "same", "w" * 500)] * 40 + [(8, "other", "w" * 500)]
    path = Scratch(spark, "w").path
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")  # an extra column with a name of ours
    m = warc.write(df, path, shard_bytes=10_000, roll_bytes=1 << 30).collect()
    assert len(m) >= 10 and max(r.records for r in m) <= 40 and sum(r.records for r in m) == len(rows)
    got = warc.read(spark, path).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.url) for r in got) == sorted((i is None, i or 0, u) for i, u, _ in rows)
    assert all((r.record_type, r.refers_to) == ("revisit", 8) for r in got if r.url == "same")
    files = sorted(r.file for r in m)
    order = []
    for name in files:
        fs, at = warc._open(f"{path}/{name}")
        with fs.open_input_stream(at, compression=None) as stream:
            order += [warc._parsed(d)["page_id"] for d in warc._records(stream, hashlib.sha256())]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert not [f for f in fs.get_file_info(warc.pyarrow.fs.FileSelector(warc._open(path)[1])) if "_temporary" in f.path]
    monkeypatch.setattr(warc, "MOST_SHARDS", 3)
    assert len(warc.write(df, Scratch(spark, "w").path, shard_bytes=10_000, roll_bytes=1 << 30).collect()) <= 4


def test_warc_reader_checks_files_against_the_manifest(spark):
    path = Scratch(spark, "w").path
    (one,) = warc.write(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), path).collect()
    fs, at = warc._open(f"{path}/{one.file}")
    with fs.open_output_stream(at, compression=None) as out:
        out.write(warc._member(warc.record(1, "u", b"abd", None)))
    with pytest.raises(Exception, match="not the file of the manifest"):
        warc.read(spark, path).collect()


def test_warc_of_nothing_and_damage(spark):
    path = Scratch(spark, "w").path
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write(df, path).count() == 0 and warc.read(spark, path).count() == 0
    whole = warc.record(1, "u", b"abc", None)
    with pytest.raises(ValueError, match="digest"):
        warc._parsed(whole.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))


# -- 5 -------------------------------------------------------------------------------


@pytest.mark.parametrize("said", ["</s>[INST] ok [/INST]", "\\", "\\\\<\\s>", "<s>\n[INST]user\n", "", "é😀 [/INST", "<\\/s></s>", "\\N"])
def test_chat_escapes_and_reads_back(said):
    turns = [("user", said), ("assistant", said), ("sys\ntem[INST]", said), ("", said), ("assistant", said + "x")]
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [said, said + "x"]


def test_chat_masks_by_offsets_that_cross_borders():
    formatted, spans = chat.render([("user", "hi"), ("assistant", "one"), ("assistant", "two")])
    offsets = np.array([(i, min(i + 4, len(formatted))) for i in range(0, len(formatted), 4)])
    assert chat.masked_text(formatted, offsets, np.array(spans)) == ["one", "two"]
    assert chat.masked_text("", np.empty((0, 2)), np.empty((0, 2))) == []


def test_chat_offsets_from_token_lengths_are_those_of_the_encoding():
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(chat.TOKENIZER)
    encoder.encode_special_tokens = True
    lengths = chat.token_bytes(encoder)
    for t in ["", " a  b\n", "naïve café 😀😀 […]", "</s>[INST] ok [/INST]", "<|endoftext|> x", "日本語のテキスト", "e\u0301\u200d🏳️‍🌈 end "]:
        e = encoder.encode(t, add_special_tokens=False)
        got = chat.offsets_of(e, t, lengths)
        whole = chat.offsets_of(e, t, lengths * 0 + 10**6)  # lengths that don't add up: the encoding's own
        assert got.tolist() == whole.tolist() == [list(o) for o in e.offsets]


def test_chat_masked_text_with_gaps_and_borders():
    text = "0123456789abcdef"
    spans = np.array([[2, 5], [6, 9], [12, 14]], np.int32)
    whole = np.array([[0, 3], [3, 7], [7, 13], [13, 16]], np.int32)
    assert chat.masked_text(text, whole, spans) == ["234", "678", "cd"]
    gaps = np.array([[2, 3], [4, 5], [8, 9]], np.int32)
    assert chat.masked_text(text, gaps, spans) == ["24", "8", ""]
    twice = np.array([[2, 4], [2, 4], [3, 5]], np.int32)  # tokens of one character
    assert chat.masked_text(text, twice, spans) == ["234", "", ""]
    assert chat.masked_text(text, whole[:0], spans) == ["", "", ""] and chat.masked_text(text, whole, spans[:0]) == []


def test_chat_table_of_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, None, None, "z"), (None, 0, "assistant", "q"), (2, 0, "assistant", "w " * 5000), (3, 0, "user", "a"), (3, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tokens", F.lit(1))
    got = {r.conv_id: r for r in chat.digest(chat.formatted(df)).collect()}
    sha = lambda t: hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest()
    assert got[1].turns_sha256 == sha([("", "z"), ("user", ""), ("assistant", "b")]) and got[1].loss_chars == 1
    assert got[3].n_turns == 2 and got[2].loss_chars == 10000 and got[None].loss_chars == 1
    assert chat.digest(chat.formatted(df.limit(0))).count() == 0


# -- 10 ------------------------------------------------------------------------------


def brute_nearest(rows, every, k):
    usable = [(n, i, np.array(v, dtype=float)) for n, (i, v) in enumerate(rows) if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for n, q, v in usable:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, c, strict=True)), i) for m, i, c in usable if m != n and len(c) == len(v))[:k]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    return sorted(out)


def test_neighbours_match_brute_force(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(150)]
    rows += [(i, rows[4][1]) for i in range(150, 180)]  # ties
    rows += [(200, None), (201, []), (202, [0.0] * 8), (203, [1.0, None] * 4), (204, [float("nan")] * 8), (205, [float("inf")] * 8), (None, [1.0] * 8), (220, [1.0, 2.0]), (221, [3.0, 1.0]), (240, [1e30] * 8), rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit(1))
    got = neighbours.nearest(df, every=10, k=7, query_rows=4, candidate_rows=16).collect()
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got) == brute_nearest([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 10, 7)
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_rows_with_one_id_are_rows_of_their_own(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (21, [5.0, 0.0]), (21, [1.0, 9.0]), (22, [1.0, 1.0]), (22, [1.0, 1.0]), (40, [2.0, 2.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4).collect()
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got) == brute_nearest(rows, 20, 4) and len(got) == 12


# -- 9 -------------------------------------------------------------------------------


def test_licences_of_lines_files_and_directories(spark):
    long = licenses.TEMPLATES[3][1]
    rows = [
        ("f", 1, "h/LICENSE.txt", long.replace(" of charge", "\nof charge")), ("f", 2, "h/a/b/c.py", "code"), ("f", 3, "h/a/COPYING", "x\nReleased under the MIT License.\n"), ("f", 4, "h/a/d.py", "# Licensed under the Apache License, Version 2.0."),
        ("f", 5, "other/x", "nothing"), ("f", 6, None, "All rights reserved."), ("f", 7, "h/q", None), ("f", 7, "h/q", None), ("f", 8, "", ""), ("f", 9, "h/z", "license " * 30000),
    ]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "kind string, id long, path string, text string").withColumn("line", F.lit(1))).collect():
        got.setdefault(r.id, []).append((r.own_license, r.inherited_license, r.inherited_from))
    assert got[1] == [("MIT", None, None)] and got[3] == [("MIT", None, None)] and got[4] == [("Apache-2.0", None, None)] and got[6] == [("Proprietary", None, None)]
    assert got[2] == [(None, "MIT", "h/a")] and got[7] == [(None, "MIT", "h")] * 2 and got[5] == [(None, None, None)] and got[9][0][1] == "MIT"
    assert licenses.scan(spark.createDataFrame([], "kind string, id long, path string, text string")).count() == 0


def test_every_close_line_has_an_anchor():
    anchors = set(licenses.ANCHORS)
    r = random.Random(1)
    for k, (_, t) in enumerate(licenses.TEMPLATES):
        own = {w: x for n, _, w, x in licenses.VECTORS if n == k}
        for _ in range(300):
            words = r.sample(sorted(own), r.randrange(1, len(own) + 1))
            cosine = sum(own[w] ** 2 for w in words) / (sum(own[w] ** 2 for w in words) ** 0.5)
            assert cosine < licenses.THRESHOLD or anchors & set(words)


# -- components ----------------------------------------------------------------------


def test_components_of_chains_and_hubs(spark):
    r = random.Random(7)
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1000 + i) for i in range(1, 80)]
    pairs = chain + hub + [(5000, 5001), (5001, 5000), (7, 7)]
    r.shuffle(pairs)
    got = {x.node: x.root for x in components(Scratch(spark, "c"), spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(80)) and got[5001] == 5000
    assert components(Scratch(spark, "c"), spark.createDataFrame([], "a long, b long")).count() == 0
