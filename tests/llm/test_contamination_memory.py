"""The benchmark stage's workers stay small, and its texts go to them once."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from quantloom.llm import _io, _text, decontam
from test_operators import contamination


def automaton(text):
    raw = _text.LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = _text.words(raw, np.array([0, len(raw)]), _text.NOT_ALNUM)
    return decontam.Automaton([(7, _text.hashes(raw, starts, ends))])


def test_a_large_batch_takes_little_memory(monkeypatch):
    monkeypatch.setattr(_text, "_powers", {})
    item = " ".join(f"i{k}" for k in range(20))
    texts = [" ".join(f"w{(i * 31 + k) % 997}" for k in range(800)) + (f" {item}" if i % 400 == 0 else "") for i in range(2000)]
    b = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts)], ["_others", "text"])
    run = decontam._scan(SimpleNamespace(value=[automaton(item)]), ["_others", "text", "_n_words", "_n_hit", "_items"], 2, False)
    tracemalloc.start()
    try:
        got = [(len(x), sum(x.column(3).to_pylist())) for x in run([b])]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert b.nbytes > 7 << 20 and sum(n for n, _ in got) == 2000 and sum(hit for _, hit in got) == 5 * 20
    assert peak < 80 << 20  # 159 MB with 4 MB at once
    assert all(t.nbytes <= 8 << 20 for t in _text._powers.values())  # what a worker keeps


def test_clean_texts_are_whole_and_sent_once(spark, edge, items):
    out = decontam.decontaminated(edge, items)
    want = contamination([(r.doc_id, r.text) for r in edge.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert out.count() == sum(not (hit and 20 * hit >= n) for _, n, hit, _ in want)
    key = lambda r: tuple((x is not None, x) for x in r)
    left = sorted(out.collect(), key=key)
    assert left == [r for r in sorted(edge.collect(), key=key) if r in left]
    d = _io.pack(edge, ["text"])
    kept = decontam.scan(d, items, whole=True)
    assert kept.columns == ["text", "_others", "_n_words", "_n_hit", "_items"]
    assert sorted((r.text is not None, r.text) for r in kept.collect()) == sorted((r.text is not None, r.text) for r in d.collect())
