"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Documents stream through the automaton, which tells at each word the longest run of words ending there that a test item contains. Runs of
WINDOW words or more, and whole shorter items, are hits. The automata (one for each block of items) are sent to all executors; their size
is bounded by the benchmark's words, which are counted first.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io, _text

WINDOW = 13
COVERAGE = 20  # a document is contaminated if COVERAGE * hit words >= its words
BLOCK_WORDS = 500_000
#: Words of all items together that may be sent to executors; about 200 bytes each.
MOST_WORDS = 5_000_000


class Automaton:
    """Over items of word hashes. States are numbered from 0, the empty run."""

    def __init__(self, items: list[tuple[int, np.ndarray]], window: int = WINDOW):
        self.window = window
        items = [(i, h) for i, h in items if len(h)]
        self.vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        self.shortest = min((min(len(h), window) for _, h in items), default=1)
        nxt: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        holds: list[set[int]] = [set()]
        ends: dict[int, list[tuple[int, int]]] = defaultdict(list)
        pairs = set()
        for item, h in items:
            ids = np.searchsorted(self.vocabulary, h).tolist()
            pairs.update(zip(ids, ids[1:]))
            last = 0
            for c in ids:
                last = self._extend(nxt, link, length, holds, last, c)
                holds[last].add(item)
            if len(ids) < window:
                ends[last].append((len(ids), item))
        n, v = len(nxt), max(1, len(self.vocabulary))
        self.n_words, self.link, self.length = v, np.array(link), np.array(length)
        order = np.argsort(-self.length, kind="stable")
        for s in order:
            if link[s] > 0:
                holds[link[s]] |= holds[s]
        # at[s]: the state of the last `window` words of s; its items are those of every window that a match at s ends with
        self.at = np.arange(n)
        for s in order[::-1]:
            if link[s] >= 0 and length[link[s]] >= window:
                self.at[s] = self.at[link[s]]
        self.items = {s: sorted(holds[s]) for s in range(n) if self.at[s] == s and length[s] >= window}
        # short items that end wherever a match is at s
        self.short: dict[int, list[tuple[int, int]]] = {}
        for s in order[::-1]:
            own = [*self.short.get(link[s], ()), *ends.get(s, ())]
            if own:
                self.short[int(s)] = own
        self.has_short = np.zeros(n, bool)
        self.has_short[list(self.short)] = True
        keys = np.array([s * v + c for s in range(n) for c in nxt[s]], np.int64)
        to = np.array([t for s in range(n) for t in nxt[s].values()], np.int64)
        by = np.argsort(keys)
        self.keys, self.to = keys[by], to[by]
        self.pairs = np.array(sorted(a * v + b for a, b in pairs), np.int64)

    @staticmethod
    def _extend(nxt, link, length, holds, last, c):
        def copy(p, q):
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            holds.append(set())
            link[q] = clone
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            return clone

        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else copy(last, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        holds.append(set())
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else copy(p, q)
        return new

    def step(self, state: np.ndarray, size: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word further for each lane: the state and length of the longest match that ends there."""
        state, size = state.copy(), size.copy()
        out = np.zeros_like(state)
        todo = np.arange(len(state))
        while len(todo):
            key = state[todo] * self.n_words + word[todo]
            i = np.searchsorted(self.keys, key)
            i[i == len(self.keys)] = 0
            ok = self.keys[i] == key
            out[todo[ok]] = self.to[i[ok]]
            size[todo[ok]] += 1
            todo = todo[~ok]
            root = state[todo] == 0
            size[todo[root]] = 0
            todo = todo[~root]
            state[todo] = self.link[state[todo]]
            size[todo] = self.length[state[todo]]
        return out, size

    def hits(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, set[tuple[int, int]]]:
        """Which of the words are inside an occurrence of a window, and the (row, item) of the windows; first: from _text.words."""
        hit = np.zeros(len(h), bool)
        if not len(self.vocabulary) or not len(h):
            return hit, set()
        ids = np.searchsorted(self.vocabulary, h)
        ids[ids == len(self.vocabulary)] = 0
        known = self.vocabulary[ids] == h
        # runs of known words whose neighbours are neighbours in an item too: no window crosses their ends
        joined = np.zeros(len(h), bool)
        two = np.flatnonzero(known[1:] & known[:-1]) + 1
        if len(self.pairs):
            key = ids[two - 1] * self.n_words + ids[two]
            i = np.searchsorted(self.pairs, key)
            i[i == len(self.pairs)] = 0
            joined[two] = self.pairs[i] == key
        joined[first[:-1][first[:-1] < len(h)]] = False
        starts = np.flatnonzero(known & ~joined)
        open_ = np.append(joined[1:], False)
        ends = np.flatnonzero(known & ~open_) + 1
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return hit, set()
        order = np.argsort(starts - ends, kind="stable")
        starts, ends = starts[order], ends[order]
        state, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        where, states, sizes = [], [], []
        left, k = len(starts), 0
        while left:
            at = starts[:left] + k
            state, size = self.step(state[:left], size[:left], ids[at])
            ok = (size >= self.window) | self.has_short[state]
            where.append(at[ok])
            states.append(state[ok])
            sizes.append(size[ok])
            k += 1
            left = int(np.searchsorted(-(ends - starts), -k, "left"))
        where, states, sizes = map(np.concatenate, (where, states, sizes))
        row = np.searchsorted(first, where, "right") - 1
        cover = np.zeros(len(h) + 1, np.int64)
        full = sizes >= self.window
        np.add.at(cover, where[full] - self.window + 1, 1)
        np.add.at(cover, where[full] + 1, -1)
        found: set[tuple[int, int]] = set()
        for r, s in np.unique(np.stack([row[full], self.at[states[full]]], 1), axis=0).tolist():
            found.update((r, item) for item in self.items[s])
        short = np.flatnonzero(self.has_short[states])
        for p, s, n, r in zip(where[short].tolist(), states[short].tolist(), sizes[short].tolist(), row[short].tolist()):
            for m, item in self.short[s]:
                if n >= m:
                    cover[p - m + 1] += 1
                    cover[p + 1] -= 1
                    found.add((r, item))
        return np.cumsum(cover[:-1]) > 0, found


def automata(benchmark: DataFrame, window: int = WINDOW) -> list[Automaton]:
    """One for each block of items (item_id, text); null texts and null ids have no part. Raises if the items have over MOST_WORDS words."""
    sizes = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if sizes > 8 * MOST_WORDS:
        raise ValueError(f"the benchmark has {sizes} bytes; over {8 * MOST_WORDS} can't be sent to every executor: run it in parts")
    out, block, n = [], [], 0
    for r in benchmark.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id").toLocalIterator():
        raw = _text.LOWER[np.frombuffer(r.text.encode(), np.uint8)]
        starts, ends, _ = _text.words(raw, np.array([0, len(raw)]), _text.NOT_ALNUM)
        block.append((r.item_id, _text.hashes(raw, starts, ends)))
        n += len(starts)
        if n >= BLOCK_WORDS:
            out.append(Automaton(block, window))
            block, n = [], 0
    return out + ([Automaton(block, window)] if block else [])


def _scan(sent, names: list[str], n_keys: int, cut: bool):
    """(_others, text) -> the first n_keys of them and the results, in ordinary slices: an executor has a worker for each task, and their memory stays
    theirs in the stages after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = sent.value
        for b in batches:
            for i, j, raw, offsets in _io.slices(b.column(1)):
                lower = _text.LOWER[raw]
                starts, ends, first = _text.words(lower, offsets, _text.NOT_ALNUM)
                h = _text.hashes(lower, starts, ends)
                hit, found = np.zeros(len(h), bool), set()
                for m in machines:
                    more, pairs = m.hits(h, first)
                    hit |= more
                    found |= pairs
                items = [[] for _ in range(j - i)]
                for r, item in sorted(found):
                    items[r].append(item)
                sums = np.concatenate(([0], np.cumsum(hit)))
                cols = [pa.array(np.diff(first)), pa.array(sums[first[1:]] - sums[first[:-1]]), pa.array(items, pa.list_(pa.int64()))]
                if cut:
                    cols.append(_without(raw, offsets, starts, ends, first, hit))
                yield pa.RecordBatch.from_arrays([*(b.column(k)[i:j] for k in range(n_keys)), *cols], names)

    return run


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, cut: bool = False, whole: bool = False) -> DataFrame:
    """docs' columns but the text, with _n_words, _n_hit and _items (the sorted distinct item_ids whose windows occur); with `cut`, also
    _cut: the text without the hit words (from a hit run's first byte to its last). With `whole` the text stays, as it is.

    docs: text, and any other columns. Words are runs of ASCII letters, digits and all beyond ASCII; A-Z count as a-z. Null and empty
    texts have no words and no hits. Items of fewer than `window` words are windows as they are; items without words are none. No
    benchmark rows: no hits. Repeated rows each get their own result.
    """
    spark = docs.sparkSession
    _io.ready(spark)
    sent = spark.sparkContext.broadcast(automata(benchmark, window))
    results = ("_n_words", "_n_hit", "_items", *["_cut"] * cut)
    keys = ["_others", "text"] if whole else ["_others"]
    names = [*keys, *results]
    d = _io.pack(docs, ["text"], results).select("_others", "text")
    out = d.mapInArrow(_scan(sent, names, len(keys), cut), _io.schema(d, keys, "_n_words long, _n_hit long, _items array<long>" + ", _cut string" * cut))
    return out.select(*_io.unpack(out, docs.columns, ["text"], results if whole else ("text", *results)), *results)


def _without(raw, offsets, starts, ends, first, hit) -> pa.Array:
    drop = np.zeros(len(raw) + 1, np.int8)
    on = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])) | hit & np.isin(np.arange(len(hit)), first))
    off = np.flatnonzero(hit & ~np.concatenate((hit[1:], [False])) | hit & np.isin(np.arange(len(hit)) + 1, first))
    drop[starts[on]] += 1
    drop[ends[off]] -= 1
    keep = np.cumsum(drop[:-1]) == 0
    at = np.concatenate(([0], np.cumsum(keep)))[offsets]
    left = raw[keep].tobytes()
    return pa.array([left[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.string())


def contaminated() -> F.Column:
    return (F.col("_n_hit") > 0) & (COVERAGE * F.col("_n_hit") >= F.col("_n_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones; the others as they are."""
    kept = scan(_io.pack(docs, ["text"]), benchmark, whole=True).where(~contaminated())
    return kept.select(*_io.unpack(docs, docs.columns, ["text"]))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    r = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_sort(F.transform("_items", lambda x: x.cast("string")))
    return r.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
