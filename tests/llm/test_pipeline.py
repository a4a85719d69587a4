"""The pipeline: stages at the small size against brute force, columns, empty and awkward tables."""

import hashlib
import re

import corpus_pipeline
import pytest

from weftgraph.llm import mixing, near_dup, toxicity
from weftgraph.llm.common import materialize, table


@pytest.fixture(scope="module")
def stages(spark):
    d, out = "/root/testdata/sf0.001", []
    docs = table(spark, d, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, d), f"test-{name}")
        out.append((before, docs))
    return d, out


def test_order_and_columns(stages):
    _, out = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "source_mix", "byte_bpe"]
    for before, after in out[:-1]:
        assert after.columns == before.columns


def test_toxic_documents_go(stages, spark):
    d, out = stages
    before, after = out[0]
    model = toxicity.fit(before, table(spark, d, "labels"))
    kept = {r["doc_id"] for r in toxicity.score(before, model).filter("not rejected").collect()}
    assert {r["doc_id"] for r in after.collect()} == kept
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, d, "labels").collect()}
    clean = [i for r in before.collect() if labels.get(i := r["doc_id"]) == 0]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)


def test_one_of_each_group_stays(stages):
    _, out = stages
    before, after = out[1]
    sets = {r["doc_id"]: {x for x in near_dup.shingle_set(r["text"], 5).tolist()} for r in before.collect()}
    kept = {r["doc_id"] for r in after.collect()}
    linked = lambda a, b: bool(a) and 100 * len(a & b) >= 80 * len(a | b)
    assert all(not linked(sets[a], sets[b]) for a in kept for b in kept if a < b)
    lost = set(sets) - kept
    assert all(any(linked(sets[i], sets[j]) for j in sets if j != i) for i in lost)


def test_the_mix_repeats_documents(stages):
    _, out = stages
    before, after = out[2]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()}
    got = [r["doc_id"] for r in after.collect()]
    assert {i: got.count(i) for i in copies} == copies


def test_last_stage_digests_every_row(stages):
    _, out = stages
    before, after = out[3]
    texts = sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in before.collect())
    assert sorted(r["decoded_sha256"] for r in after.collect()) == texts


def test_run_on_awkward_tables(spark, odd_docs, no_docs, clashing, tmp_path):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 12)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", clashing(odd_docs)), ("none", no_docs)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert all(re.fullmatch("[0-9a-f]{64}", r["ids_sha256"]) for r in rows)
        assert name == "odd" or not rows
