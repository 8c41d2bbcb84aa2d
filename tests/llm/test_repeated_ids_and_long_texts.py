"""Ids that come twice, very long texts, names that differ in case, other tokenizers, and the shards' law stated plainly."""

import hashlib
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from quantloom.llm import _io, binary_records, decontam, infill, licenses, mixing, neardup, pii, quality, sharding, substrings, toxicity
from test_operators import TOKENIZERS, W


def own_order(spark, rows):
    """(doc_id, text) in the order of ids, then of a hash of the text; nulls are left out."""
    d = spark.createDataFrame(rows, "doc_id long, text string").where("doc_id is not null").withColumn("h", F.xxhash64("text"))
    return [(r.doc_id, r.text) for r in d.orderBy("doc_id", "h").collect()]


def left_over(ordered):
    """Counts of (doc_id, words, removed, text left): an earlier row's windows go, and a row equal to the one before has its result."""
    seen, out, last = {}, [], None
    for k, (i, t) in enumerate(ordered):
        if (i, t) != last:
            w, last = W.findall(t or ""), (i, t)
            gone = [False] * len(w)
            for j in range(len(w) - 19):
                if seen.setdefault(tuple(w[j : j + 20]), (k, j)) < (k, j):
                    gone[j : j + 20] = [True] * 20
            result = (i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
        out.append(result)
    return sorted(out)


def test_no_text_is_lost_where_ids_come_twice(spark, tmp_path, monkeypatch):
    w, v = (" ".join(f"{c}{k}" for k in range(30)) for c in "wv")
    rows = [(1, w), (2, w), (2, v), (3, v), (3, v), (4, None), (4, ""), (None, w), (None, v), (5, v + " end")]
    r = random.Random(8)
    common = [f"c{k}" for k in range(30)]
    for _ in range(150):
        t = [f"x{r.randint(0, 300)}" for _ in range(r.randint(0, 50))]
        rows.append((r.randint(10, 60), " ".join(t + common[: r.randint(20, 30)] + t[:5])))
    rows += rows[-20:]
    want = left_over(own_order(spark, rows))
    for words, frequent in ((substrings.SHARD_WORDS, substrings.FREQUENT), (60, 10**9)):
        monkeypatch.setattr(substrings, "SHARD_WORDS", words)
        monkeypatch.setattr(substrings, "FREQUENT", frequent)
        got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(tuple(x) for x in got) == [x for x in want if x[2]]
    kept = " ".join(x[3] for x in want).split()
    assert {f"v{k}" for k in range(30)} <= set(kept) and {f"w{k}" for k in range(30)} <= set(kept)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = [tuple(x) for x in substrings.op3(spark, str(tmp_path)).collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(x for x in out if x[0] is not None) == sorted((i, n, k, sha(t)) for i, n, k, t in want) and len(out) == len(rows)


def test_added_spans_of_a_long_text_in_linear_time():
    model = pii.field()
    line = "write to ann.lee (at) mail.example or call 415-555-2671, then 10.0.0.1 and a@b.example or 7 things; "
    took = []
    for n in (2_000, 8_000):
        began = time.perf_counter()
        (base, more), = pii.find([line * n], model)
        took.append(time.perf_counter() - began)
        assert len(more) >= n
        spans = sorted([s for own in base for s in own] + [(a, b) for _, a, b in more])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]) if a not in [s for s in base[1]])
    assert took[1] < 10 * took[0]


def test_spans_that_are_free():
    r = random.Random(1)
    for _ in range(300):
        cuts = sorted(r.sample(range(60), 12))
        spans = list(zip(cuts[::2], cuts[1::2]))
        a = r.randint(0, 58)
        b = r.randint(a + 1, 60)
        assert pii._free(spans, a, b) == all(b <= x or y <= a for x, y in spans)


def test_shape_is_of_the_whole_token():
    long = "1a" * 40
    assert pii.shape(long + "-x") != pii.shape(long + "x-") and len(pii.shape(long * 1000)) < 200


def test_one_of_equal_rows_stays(spark):
    text = "the cat sat on the mat and then it sat on the hat of the dog"
    rows = [(1, text, "a"), (1, text, "a"), (1, text, "b"), (1, "another text of the same id as before with words", "a"), (2, text, "a"), (None, text, "a"), (None, text, "a"), (3, None, "a"), (3, None, "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    got = sorted(((x.doc_id, x.text) for x in neardup.deduplicated(d).collect()), key=str)
    assert got == sorted([(1, text), (1, rows[3][1]), (3, None), (None, text), (None, text)], key=str) and neardup.deduplicated(d).columns == d.columns


def test_names_are_compared_without_case(spark, edge, labels, items):
    more = edge
    for c in ("KEPT", "Spans", "_N_hit", "_SIZE", "_Shard", "Families", "_Score", "_FORM"):
        more = more.withColumn(c, F.lit(7))
    model = licenses.Classifier(["words of no licence at all"], rounds=5)
    results = {
        "op1": mixing.mix(more), "op4": sharding.shard(more), "op5": licenses.scan(more, model), "op6": pii.scan(more), "op7": decontam.scan(more, items), "op8": quality.judge(more, labels),
        "op9": toxicity.score(more, *toxicity.fitted(more, labels)), "op12": infill.infill(more), "stage": sharding.shard(more.withColumn("Shard", F.lit(1)), names=("shard", None, "slot")),
    }
    for name, out in results.items():
        assert len({c.lower() for c in out.columns}) == len(out.columns), name
        assert _io.keep(out, "test").count() == 12, name


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    assert binary_records.Encoder(TOKENIZERS.path("byte_bpe_50k.json")).by_words
    path = TOKENIZERS.path("word_bpe_49k.json")
    e, t = binary_records.Encoder(path), Tokenizer.from_file(path)
    texts = ["The cat  sat", "", "  A\n\nb é ", "it's 12 o'clock"]
    import numpy as np

    assert not e.by_words and [np.frombuffer(x, e.kind).tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert not binary_records.cuts_at_spaces({"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}) and not binary_records.cuts_at_spaces({"pre_tokenizer": {"type": "Sequence"}})


def plain_shard(key, weights):
    """The shard of highest -w / ln(u), u from the first 52 bits of md5(key:shard)."""
    u = lambda i: (int(hashlib.md5(f"{'null' if key is None else key}:{i}".encode()).hexdigest()[:13], 16) + 1) / 2**52
    scores = [(w / -math.log(u(i) * (1 - 2**-53)), -i) for i, w in enumerate(weights) if w > 0]
    return -max(scores)[1]


def test_shards_are_those_of_the_law(spark, sf):
    for r in sharding.op4(spark, sf).collect():
        assert (r.shard, r.grown_shard) == (plain_shard(r.doc_id, [1.0] * 8), plain_shard(r.doc_id, [1.0] * 9))


@pytest.mark.parametrize("text", ["GPL is not used here, nor is any other licence", "this is not licensed under the MIT licence"])
def test_negated_mentions_are_no_licences(text):
    model = licenses.Classifier(["words of no licence at all", "the mat and the hat sat there"])
    assert model.judge(licenses._words(text))[0] == 0
