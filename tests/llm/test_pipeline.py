"""The pipeline against brute force, stage by stage on its own input."""

import pytest

import corpus_pipeline
from test_operators import W, contamination, near, table, water

from quantloom.llm import _io, toxicity


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(_io.keep(stage(spark, docs[-1], sf), "test"))
    return docs


def test_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[1:-1]) and stages[-1].columns == [*stages[0].columns, "shard", "slot"]


def test_toxicity(spark, sf, stages):
    model, marks = toxicity.fitted(stages[0], spark.read.parquet(f"{sf}/labels.parquet"))
    ok = toxicity.score(stages[0], model, marks).where("_score < 0.5").drop("_score")
    assert stages[1].exceptAll(ok).count() == 0 and ok.exceptAll(stages[1]).count() == 0


def test_near_duplicates(stages):
    want = {i for i, c in near(table(stages[1]), 80).items() if i == c}
    assert {r.doc_id for r in stages[2].collect()} == want


def test_benchmark(spark, sf, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {i for i, n, hit, _ in contamination(table(stages[2]), items) if not (hit and 20 * hit >= n)}
    assert {r.doc_id for r in stages[3].collect()} == want


def test_mix(stages):
    size, taken = {}, {}
    for r in stages[3].collect():
        size[r.source] = size.get(r.source, 0) + len(W.findall(r.text or ""))
    for r in stages[4].collect():
        taken[r.source] = taken.get(r.source, 0) + len(W.findall(r.text or ""))
    want = water(size, {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size))})
    longest = {}
    for r in stages[3].collect():
        longest[r.source] = max(longest.get(r.source, 0), len(W.findall(r.text or "")))
    assert all(abs(taken.get(s, 0) - want[s]) <= longest[s] / 2 + 0.5 for s in size)
    texts = {(r.doc_id, r.text) for r in stages[3].collect()}
    assert all((r.doc_id, r.text) in texts for r in stages[4].collect())


def test_shards(spark, sf, stages):
    got = stages[5].collect()
    assert len(got) == stages[4].count()
    for s in range(8):
        slots = sorted(r.slot for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    shards = {}
    for r in got:
        assert shards.setdefault(r.doc_id, r["shard"]) == r["shard"]


def test_run_is_the_stages(spark, sf, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, stages[-1].collect()))


@pytest.mark.parametrize("which", ["edge", "empty", "clashing"])
def test_every_stage_takes_odd_tables(request, spark, sf, which):
    docs = request.getfixturevalue(which)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert set(docs.columns) <= {*out.columns, "shard", "slot"} and out.count() <= 2 * docs.count() + 8, name
