"""The pipeline's stages, each against brute force over what the one before it kept."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reachspark.llm import toxicity

from .test_operators import DOCS, brute_contamination, brute_near_copies, brute_repeats, documents, frame, labelled, spaced


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows, labels, _ = labelled(11, 200)
    odd = [((1000 + i) if i is not None else None, t, lang, s, n) for i, t, lang, s, n in documents(12, 50)]
    r = random.Random(1)
    near = [(2000 + k, " ".join(w for w in spaced(rows[k][1]) if r.random() > 0.02), "en", "s", 0) for k in range(0, 60, 3)]
    frame(spark, rows + odd + near, DOCS).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 1, y) for d, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, " ".join(spaced(rows[20][1])[3:20])), (2, " ".join(spaced(odd[7][1])[:14]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), items


def test_each_stage_on_what_the_one_before_kept(spark, folder, tmp_path):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "mixing_to_target_weights"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        after = [tuple(r) for r in out.collect()]
        key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
        if name == "toxicity":
            scored = toxicity.toxicity(docs, spark.read.parquet(f"{path}/labels.parquet")).collect()
            gone = {r.doc_id for r in scored if r.predicted}
            assert gone and sorted(after, key=key) == sorted((r for r in before if r[0] not in gone), key=key)
        elif name == "simhash_near_dedup":
            assert len(after) < len(before) and sorted(after, key=key) == sorted((before[i] for i in brute_near_copies([r[:2] for r in before])), key=key)
        elif name == "substring_dedup":
            removed = {d: n for d, _, n, _ in brute_repeats([r[:2] for r in before])}
            kept = {d: sha for d, _, _, sha in brute_repeats([r[:2] for r in before])}
            assert sum(removed.values()) > 0 and len(after) == len(before)
            old = {r[0]: r for r in before}
            for r in after:
                n = removed[-1 if r[0] is None else r[0]]
                assert r == old[r[0]] if not n else len(spaced(r[1])) == len(spaced(old[r[0]][1])) - n and r[4] == len(r[1])
                assert not n or hashlib.sha256(r[1].encode()).hexdigest() == kept[-1 if r[0] is None else r[0]]  # the very words that stay
        elif name == "benchmark_decontamination":
            bad = {d for d, *_, c in brute_contamination([r[:2] for r in before], items) if c}
            assert sorted(after, key=key) == sorted((r for r in before if r[0] not in bad), key=key)
        else:
            assert sorted((r[: len(columns)] for r in after), key=key) == sorted(before, key=key)
            assert len({r[-1] for r in after}) == len(after)
        assert out.columns[: len(columns)] == columns and (out.columns == columns or k == 4)
        docs = out


def test_run_is_the_stages_in_order(spark, folder):
    path, _ = folder
    out = corpus_pipeline.run(spark, path)
    assert out.count() == out.select("mix_position").distinct().count() > 100
