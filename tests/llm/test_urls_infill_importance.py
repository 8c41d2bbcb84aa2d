"""URL filters, fill-in-the-middle and importance resampling against plain statements of their contracts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import _io, importance, infill, urls
from test_operators import A, low, table

lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- 11 -------------------------------------------------------------------------------------------------------------------------------


def split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    return lower(host), re.match("[^?#]*", rest[len(host) :])[0]


def plain_verdict(url, rules, listed):
    host, path = split(url)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "block" if host in listed else "allow"
    best = max(fits)
    return host, path, best[1], best[2]


URLS = [
    "http://a.net/", "http://net/x", "HTTP://A.Example.NET/en/1", "https://example.net/en", "https://notexample.net/en/", "http://example.com/de/?q#f", "http://example.com/de", "x://org/fr/", "http://a.b.org/fr/ü", "http://org",
    "http://net", "no scheme", "", None, "://", "http://bad.host?x", "http://bad.host", "http://sub.bad.host/", "http://é.net/", "http://a.net./", "http://user@a.net:80/z", "mailto:x://net/en/\nnew", "http://" + "a." * 3000 + "net/" + "p/" * 30_000,
]


def judged(spark, texts, **options):
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id long, url string")
    return [(r._host, r._path, r._rule, r._verdict) for r in urls.judge(pages, **options).orderBy("page_id").collect()]


def test_urls_by_rules_and_list(spark):
    listed = spark.createDataFrame([("bad.host",), (None,), ("bad.host",), ("never.seen",)], "host string")
    assert judged(spark, URLS, listed=listed) == [plain_verdict(u, urls.RULES, {"bad.host"}) for u in URLS]
    assert judged(spark, URLS) == [plain_verdict(u, urls.RULES, ()) for u in URLS]
    rules = [("allow", "net", ""), ("block", "net", ""), ("block", "a.example.net", "/en/1"), ("allow", "host", "/")]
    assert judged(spark, URLS, rules=rules, listed=listed, most=2) == [plain_verdict(u, rules, {"bad.host"}) for u in URLS]
    assert judged(spark, URLS, rules=spark.createDataFrame([], "verdict string, host string, path string")) == [(*split(u), None, "allow") for u in URLS]


@pytest.mark.parametrize("n, every, most", [(30_000, 50, 10**6), (3_000, 2, 10**6), (3_000, 3, 400), (50, 1, 10**6)])
def test_cascade_is_exact_for_its_keys(spark, n, every, most):
    keys = spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % every == 0).alias("listed"))
    cascades = urls.build(keys.unionByName(keys.where("not listed")), most)
    assert len(cascades) == max(1, -(-len(range(0, n, every)) // most)) and (every == 1 or all(len(c.levels) > 1 for c in cascades))
    found = F.lit(False)
    for c in cascades:
        found = found | c.contains(F.col("key"))
    assert keys.where(found != F.col("listed")).count() == 0


def test_cascade_of_nothing(spark):
    keys = spark.createDataFrame([("a", False), (None, True)], "key string, listed boolean")
    assert urls.build(keys) == [] and urls.build(keys.limit(0)) == []


def test_urls_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", 7, 7, 7), (1, "http://a.net/", 7, 7, 7), (2, None, 7, 7, 7)], "page_id long, url string, key int, _HOST int, `a.b` int")
    out = _io.keep(urls.judge(pages), "test")
    assert out.columns == ["page_id", "url", "key", "a.b", "_host", "_path", "_rule", "_verdict"] and out.count() == 3
    assert urls.judge(pages.limit(0)).count() == 0 and urls.allowed(pages).columns == pages.columns and urls.allowed(pages).count() == 1
    plan = urls.judge(pages)._jdf.queryExecution().toString()
    assert not re.search("Join|Python|Arrow|Exchange", plan.split("== Physical Plan ==")[1])


# --- 12 -------------------------------------------------------------------------------------------------------------------------------


def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    x, n = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest(), len(units)
    h1, h2, _, h4 = (int(x[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 50:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


ODD = ["a\nb", "\n", "\n\n\n", "x", "a\r\nb\n", "é\n日本\n𝄞\n", "has <P> in it\nand more", "<S", "<\n<S\nS>\nP>\n<M\n", "a\u2028b\x85c\x0b\n", "no end", "q\n" * 40_000, None, ""]


def test_infill_of_lines(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(ODD * 12)] + [(None, "a\nb\nc"), (1, "a\nb"), (1, "a\nb")], "doc_id long, text string")
    rows = infill.restored(infill.infill(d.withColumn("t", F.col("text")))).collect()
    assert len(rows) == d.count() and {r._form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert tuple(r[c] for c in infill.RESULTS) == plain_infill(r.doc_id, r.t)
        assert r._text == infill.restore(r._out, r._form) == (r.t or "")


def test_infill_of_words_and_characters():
    r = random.Random(3)
    for k in range(2000):
        text = "".join(r.choice("ab \n\té𝄞<PSM>") for _ in range(r.randint(0, 30)))
        h = infill.draws(5, k)
        for unit, pattern in (("word", r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"), ("char", r"(?s)."), ("line", r"[^\n]*\n|[^\n]+")):
            units = re.findall(pattern, text)
            n, form, prefix, middle, out = infill.transform(text, h, unit, rate=70)
            assert n == len(units) and infill.restore(out, form) == text
            if form != "plain":
                a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                assert prefix == len("".join(units[:a])) and middle == len("".join(units[a:b])) and h[2] % 100 < 70
    with pytest.raises(ValueError):
        infill.transform("a", (1, 2, 3, 4), "page")


def test_infill_edges(spark, edge, empty, clashing):
    out = _io.keep(infill.infill(clashing.withColumn("_FORM", F.lit("own"))), "test")
    assert out.columns == [c for c in clashing.columns if c != "text"] + list(infill.RESULTS) and out.count() == 12
    assert infill.infill(empty).count() == 0 and infill.infill(edge).where("_out is null").count() == 0


def test_infill_carries_bytes_that_are_not_utf8(spark):
    d = spark.createDataFrame([(k, bytearray(b"a\n\xff\xfe b\n\xc3\nend" + bytes([65 + k]))) for k in range(9)], "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    out = infill.restored(infill.infill(d)).join(d, "doc_id").select(F.hex("_text").alias("a"), F.hex("text").alias("b")).collect()
    assert all(r.a == r.b for r in out)


# --- 13 -------------------------------------------------------------------------------------------------------------------------------


def test_crc_of_many_words_at_once():
    r = random.Random(4)
    words = [bytes(r.randrange(256) for _ in range(n)) for n in [*range(0, 70), 200, 5000] * 4]
    raw, at = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])
    state = np.array([r.randrange(2**32) for _ in words], np.uint32)
    assert importance.crc32s(raw, at[:-1], at[1:]).tolist() == [zlib.crc32(w) for w in words]
    assert importance.crc32s(raw, at[:-1], at[1:], state).tolist() == [zlib.crc32(w, s) for w, s in zip(words, state.tolist())]


def features(text):
    w = A.findall(low(text))
    return len(w), Counter(zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def plain_resample(docs, target):
    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, f in own:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    of_s, of_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (of_s + 10_000) / ((s[k] + 1) * (of_t + 10_000)))) for k in range(10_000)]
    out = []
    for i, n, f in own:
        size = sum(f.values())
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[k] * c for k, c in f.items()) // size if size else 0
        out.append((i, n, size, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = fit[: 25 * len(fit) // 100]
    return sorted((*r[:1], *r[2:], k) for k, r in enumerate(drawn, 1)), Counter((*r[:1], *r[2:]) for r in out)


def held(got, docs, target):
    drawn, every = plain_resample(docs, target)
    assert sorted(tuple(r) for r in got if r.rank) == drawn and Counter(tuple(r)[:4] for r in got) == every


def test_resampling_of_documents(spark, sf, docs):
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held(importance.op13(spark, sf).collect(), table(docs), target)


def test_resampling_edges(spark, edge, empty, clashing, items):
    target = [r.text for r in items.collect()]
    more = clashing.withColumn("_n", F.lit(1)).withColumn("Score", F.lit(1)).withColumn("bucket", F.lit(1))
    held(importance.resample(more, items).select("doc_id", "n_features", "weight", "score", "rank").collect(), table(edge), target)
    assert importance.resample(empty, items).count() == 0
    held(importance.resample(edge, items.limit(0)).select("doc_id", "n_features", "weight", "score", "rank").collect(), table(edge), [])


def test_matrix_is_kept_in_blocks(spark, docs):
    matrix = importance.blocks(docs.repartition(3))
    n, rows = matrix.count(), matrix.select(F.explode("doc_ids")).count()
    assert n == 3 and rows == docs.count()
    sums = {r.bucket: r.n for r in importance.column_sums(matrix).collect()}
    want = Counter()
    for _, t in table(docs):
        want.update(features(t)[1])
    assert sums == want


def test_ranks_of_equal_scores(spark):
    rows = spark.createDataFrame([(i, 20 + i % 2 * -1, 1, 0, 5 - i % 10 // 5 * 300) for i in range(100)], "doc_id long, n_words long, n_features long, weight long, score long")
    got = [(r.rank, r.doc_id) for r in importance.ranked(rows, share=50).where("rank is not null").orderBy("rank").collect()]
    want = sorted((i for i in range(0, 100, 2)), key=lambda i: (i % 10 // 5, i))[:25]
    assert got == list(enumerate(want, 1))
