"""Substring dedup: repeated word windows, found in a compressed FM-index per shard.

1. Each document is cut into segments, the runs of consecutive windows that share an anchor (the least hash of ANCHOR consecutive words in a
   window, at its first place). Equal windows have equal anchors, so only segments whose anchor occurs twice or more can hold a repeat.
2. The distinct segments are dealt to shards by anchor. A shard's FM-index is a wavelet matrix over the Burrows-Wheeler transform of its
   segments; backward search gives for each window of a streamed segment the interval of its occurrences, and so the first.
3. The intervals go back to the documents, and the words they cover are cut.

No anchor is a group without bound. Those that a sample of documents shows to be very frequent are not dealt as one group in step 1: their
segments are cut into single windows, and the windows that are as frequent need no count to be known as repeated. In step 2 the distinct
segments of each anchor are counted; one with over SHARD_WORDS words has no shard, but each of its windows is counted as it is, combined before
the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io, _text

WINDOW = 20
ANCHOR = 6
SAMPLE = 4096  # documents, about, that show frequent anchors
FREQUENT = 8  # times in the sample
SHARD_WORDS = 1_500_000
#: So many document ids at most are sent to all executors (8 bytes each); more are joined by shuffle.
SEND_IDS = 1_000_000

_P = 0x9E3779B97F4A7C15 | 1


def run_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each h[start:end]."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * _text._power_table(_P, len(h)), out=sums[1:])
        x = (sums[ends] - sums[starts]) * _text._power_table(_text._inverse(_P), len(h) + 1)[starts]
        return _text.mix(x ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def segments(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, end) of the runs of windows with one anchor, as words; all in order."""
    at = _text.whole(first, WINDOW)
    if not len(at):
        return np.zeros(0, np.uint64), at, at
    m = _text.grams(h, ANCHOR)
    place, width, span = np.arange(len(m)), 1, WINDOW - ANCHOR + 1
    while 2 * width <= span:  # the least of 1, 2, 4, ... in a row, and its first place
        left = m[:-width] <= m[width:]
        place = np.where(left, place[:-width], place[width:])
        m = np.where(left, m[:-width], m[width:])
        width *= 2
    far = at + span - width
    left = m[at] <= m[far]
    least, place = np.where(left, m[at], m[far]), np.where(left, place[at], place[far])
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(at)) - 1
    return least[begin], at[begin], at[last] + WINDOW


def _hashed(raw, offsets):
    starts, ends, first = _text.words(raw, offsets)
    return _text.hashes(raw, starts, ends), starts, ends, first


def _rows(frequent: np.ndarray | None, known: np.ndarray | None):
    """(doc_id, text) -> (anchor, seg, doc_id, start, n, known): the segments; those of frequent anchors as windows, `known` if those are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for i, j, raw, offsets in _io.slices(b.column(1)):
                h, _, _, first = _hashed(raw, offsets)
                anchor, start, end = segments(h, first)
                sure = np.zeros(len(anchor), bool)
                if frequent is not None and len(frequent):
                    hot = np.isin(anchor, frequent)
                    n = end[hot] - start[hot] - WINDOW + 1
                    at = np.repeat(start[hot] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    w = run_hashes(h, at, at + WINDOW)
                    anchor, start, end = np.concatenate((anchor[~hot], w)), np.concatenate((start[~hot], at)), np.concatenate((end[~hot], at + WINDOW))
                    sure = np.concatenate((sure[~hot], np.isin(w, known)))
                seg = run_hashes(h, start, end)
                row = np.searchsorted(first, start, "right") - 1
                cols = [pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64)), ids.take(pa.array(row + i)), pa.array((start - first[row]).astype(np.int32)), pa.array((end - start).astype(np.int32)), pa.array(sure)]
                yield pa.RecordBatch.from_arrays(cols, ["anchor", "seg", "doc_id", "start", "n", "known"])

    return run


_ROWS = "anchor long, seg long, doc_id long, start int, n int, known boolean"


def _frequent(docs: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors, and windows of these, that are FREQUENT in a sample of about SAMPLE documents; at most SAMPLE documents' windows / FREQUENT."""
    some = _io.keep(docs.sample(min(1.0, SAMPLE / max(1, rows)), seed=7), "sample")
    often = lambda df: np.sort(np.array([r.anchor for r in df.groupBy("anchor").count().where(F.col("count") >= FREQUENT).select("anchor").toLocalIterator()], np.int64).view(np.uint64))
    anchors = often(some.mapInArrow(_rows(None, None), _ROWS))
    windows = often(some.mapInArrow(_rows(anchors, anchors[:0]), _ROWS).where("n = %d" % WINDOW)) if len(anchors) else anchors
    return anchors, windows


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor, those whose anchor comes twice or more. The last row of a batch waits for the next."""
    held, seen = None, False
    for b in batches:
        if not len(b):
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        a = np.asarray(b.column(0))
        same = a[1:] == a[:-1]
        twice = np.concatenate(([seen], same)) | np.concatenate((same, [False]))
        yield b.slice(0, len(b) - 1).filter(pa.array(twice[:-1]))
        held, seen = b.slice(len(b) - 1), bool(twice[-1])
    if seen:
        yield held


def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, [(anchor, seg, doc_id, start, n)]) -> the segments' word hashes, 4 bytes each"""
    for b in batches:
        where = b.column(1)
        for i, j, raw, offsets in _io.slices(b.column(0)):
            h, _, _, first = _hashed(raw, offsets)
            part = where.slice(i, j - i)
            flat = part.flatten()
            row = np.repeat(np.arange(j - i), np.diff(np.asarray(part.offsets)))
            start, n = np.asarray(flat.field("start")).astype(np.int64), np.asarray(flat.field("n")).astype(np.int64)
            at = first[row] + start
            ok = np.flatnonzero(at + n <= first[row + 1])  # else they are of another row with this doc_id
            ok = ok[run_hashes(h, at[ok], at[ok] + n[ok]).view(np.int64) == np.asarray(flat.field("seg"))[ok]]
            short = (h >> np.uint64(32)).astype(np.uint32)
            words = [short[a : a + m].tobytes() for a, m in zip(at[ok].tolist(), n[ok].tolist())]
            kept = flat.take(pa.array(ok))
            yield pa.RecordBatch.from_arrays([*(kept.field(c) for c in ("anchor", "seg", "doc_id", "start")), pa.array(words, pa.binary())], ["anchor", "seg", "doc_id", "start", "words"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, [(seg, start, n)]) -> (doc_id, start, window), a hash of each window of the segments"""
    for b in batches:
        where = b.column(2)
        for i, j, raw, offsets in _io.slices(b.column(1)):
            h, _, _, first = _hashed(raw, offsets)
            part = where.slice(i, j - i)
            flat = part.flatten()
            row = np.repeat(np.arange(j - i), np.diff(np.asarray(part.offsets)))
            start, n = np.asarray(flat.field("start")).astype(np.int64), np.asarray(flat.field("n")).astype(np.int64)
            at = first[row] + start
            ok = np.flatnonzero(at + n <= first[row + 1])  # else they are of another row with this doc_id
            ok = ok[run_hashes(h, at[ok], at[ok] + n[ok]).view(np.int64) == np.asarray(flat.field("seg"))[ok]]
            many = n[ok] - WINDOW + 1
            row, place = np.repeat(row[ok], many), np.repeat(at[ok] - np.cumsum(many) + many, many) + np.arange(many.sum())
            cols = [b.column(0).take(pa.array(row + i)), pa.array((place - first[row]).astype(np.int32)), pa.array(run_hashes(h, place, place + WINDOW).view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "window"])


def _again(found: DataFrame, near: DataFrame) -> DataFrame:
    """Spans (doc_id, start, n, mask) of the windows of the segments `found` that occur earlier in these, counted one by one."""
    lists = found.groupBy("doc_id").agg(F.collect_list(F.struct("seg", "start", "n")).alias("at"))
    windows = _io.keep(near.join(lists, "doc_id").select("doc_id", "text", "at").mapInArrow(_windows, "doc_id long, start int, window long"), "windows")
    at = F.struct("doc_id", "start")
    first = windows.groupBy("window").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return windows.join(first, "window").where(at != F.col("first")).select("doc_id", "start", F.lit(WINDOW).alias("n"), F.lit(None).cast("binary").alias("mask"))


class Wavelet:
    """A wavelet matrix over symbols: rank() of many (symbol, place) at once. A bit of each symbol a level, packed, with counts every 64."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n = len(symbols)
        self.levels = []
        self.bits = max(1, int(sigma - 1).bit_length())
        x = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (x >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate((packed, np.zeros(16 - len(packed) % 8, np.uint8))).view(np.uint64)
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(packed)))).astype(np.int64)
            zeros = int(self.n - counts[-1])
            self.levels.append((packed, counts, zeros))
            x = np.concatenate((x[bit == 0], x[bit == 1]))
        # where each symbol's block begins at the last level
        self.begins = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _ones(self, k: int, place: np.ndarray) -> np.ndarray:
        packed, counts, _ = self.levels[k]
        at, left = place >> 6, (place & 63).astype(np.uint64)
        return counts[at] + np.bitwise_count(packed[at] & ((np.uint64(1) << left) - np.uint64(1)))

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            ones = self._ones(k, place)
            place = np.where((symbol >> (self.bits - 1 - k)) & 1, self.levels[k][2] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How many of symbols[:place] are the symbol."""
        return self._descend(symbol, place) - self.begins[symbol]


class FMIndex:
    """Over a text of symbols (0 ends a segment), for patterns of up to `depth` symbols: suffixes are sorted by so many, ties by place."""

    def __init__(self, text: np.ndarray, depth: int = WINDOW):
        n = len(text)
        self.depth = depth
        rank, ranks, width = text.astype(np.int64), {}, 1
        while width < depth:
            ranks[width] = rank
            if 2 * width <= depth:
                rank, width = self._joined(rank, rank, width, n), 2 * width
            else:
                break
        ranks[width] = rank
        one_less = self._prefix(ranks, depth - 1, n)
        full = self._prefix(ranks, depth, n)
        self.sa = np.argsort(full, kind="stable")
        sigma = int(text.max()) + 1 if n else 1
        self.bwt = Wavelet(text[self.sa - 1], sigma)
        counts = np.bincount(text, minlength=sigma)
        self.before = np.cumsum(counts) - counts
        # the suffixes with the same depth - 1 symbols as the i-th
        g = one_less[self.sa]
        new = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(new, n))
        self.low, self.high = np.repeat(new, size), np.repeat(new + size, size)

    @staticmethod
    def _joined(a: np.ndarray, b: np.ndarray, k: int, n: int) -> np.ndarray:
        """Ranks of (a[i], b[i + k])."""
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = b[k:] + 1
        key = a * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        s = key[order]
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(np.concatenate(([0], (s[1:] != s[:-1]).astype(np.int64)))) if n else 0
        return out

    def _prefix(self, ranks: dict[int, np.ndarray], depth: int, n: int) -> np.ndarray:
        out, done = None, 0
        for width in sorted(ranks, reverse=True):
            while done + width <= depth:
                out = ranks[width] if out is None else self._joined(out, ranks[width], done, n)
                done += width
        return out

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the intervals of symbol + pattern."""
        both = self.bwt.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high))) + np.tile(self.before[symbol], 2)
        return both[: len(low)], both[len(low) :]

    def first_of_windows(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Stream the segments text[start:end] from their ends: (place, where its window first occurs in the index) of each window."""
        order = np.argsort(starts - ends, kind="stable")
        starts, ends = starts[order], ends[order]
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.sa), np.int64)
        k, live = 0, len(starts)
        while live:
            if k >= self.depth:  # drop the last word: the suffixes with one symbol fewer in common
                low, high = self.low[low], self.high[high - 1]
            place = ends[:live] - 1 - k
            low, high = self.extend(low, high, text[place])
            k += 1
            if k >= self.depth:
                yield place, self.sa[low]
            live = int(np.searchsorted(starts - ends, -k, "left"))
            low, high = low[:live], high[:live]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor: (seg, doc_id, start, mask); a bit of the mask for each window that occurs earlier in the index too."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.column(4).nbytes // 4
        if n >= SHARD_WORDS:
            table = pa.Table.from_batches(held).combine_chunks()
            a = np.asarray(table["anchor"])
            cut = int(np.searchsorted(a, a[-1], "left"))
            if cut:
                yield _shard(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                n = sum(x.column(4).nbytes // 4 for x in held)
    if held:
        yield _shard(pa.Table.from_batches(held).combine_chunks())


def _shard(t: pa.Table) -> pa.RecordBatch:
    t = t.sort_by([("doc_id", "ascending"), ("start", "ascending")]).combine_chunks()
    lists = t["words"].to_pylist()
    n = np.array([len(w) // 4 for w in lists], np.int64)
    words, coded = np.unique(np.frombuffer(b"".join(lists), np.uint32), return_inverse=True)
    text = np.zeros(int(n.sum()) + len(n), np.int64)
    start = np.cumsum(n + 1) - n - 1
    text[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())] = coded + 1
    index = FMIndex(text)
    earlier = np.zeros(len(text) + 1, bool)
    for place, first in index.first_of_windows(text, start, start + n):
        earlier[place[first < place]] = True
    masks = [np.packbits(earlier[a : a + m], bitorder="little").tobytes() for a, m in zip(start.tolist(), (n - WINDOW + 1).tolist())]
    cols = [t["seg"], t["doc_id"], t["start"]]
    return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in cols), pa.array(masks, pa.binary())], ["seg", "doc_id", "start", "mask"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, n_words, kept_sha256 if every word stays)"""
    for b in batches:
        n, sums = [], []
        for t in b.column(1):
            words = (t.as_buffer().to_pybytes() if t.is_valid else b"").split()
            n.append(len(words))
            sums.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sums)], ["doc_id", "n_words", "kept_sha256"])


def covered(n_words: int, spans: list[dict]) -> np.ndarray:
    """Which of a document's words the spans (start, n, mask or None for all of its windows) cover."""
    edge = np.zeros(n_words + 1, np.int64)
    for s in spans:
        a, n, mask = s["start"], s["n"], s["mask"]
        if a + n > n_words:
            continue
        if mask is None:
            edge[a] += 1
            edge[a + n] -= 1
        else:
            at = np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=n - WINDOW + 1, bitorder="little")) + a
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) -> (doc_id, n_words, n_removed, kept text)"""
    for b in batches:
        out = []
        for i, t, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            words = (t.as_buffer().to_pybytes() if t.is_valid else b"").split()
            gone = covered(len(words), spans.as_py())
            out.append((i, len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode()))
        cols = zip(*out) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_words", "n_removed", "kept"])


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """(rows, names, count): rows (doc_id, text) without null ids, in which a doc_id stands for one text, and their count.

    Where ids come once that is docs itself, and names is None. Otherwise each distinct (doc_id, text) is one row, with a number in place of its id, in their
    order, and names (doc_id, named, copies) has the ids that the numbers stand for, and how many rows are equal.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    n = d.groupBy("doc_id").count().agg(F.sum("count").alias("rows"), F.max("count").alias("most")).first()
    if (n.most or 0) < 2:
        return d, None, n.rows or 0
    d = d.withColumn("_h", F.xxhash64("text"))
    # the ranges of a sort are in order, and so are the ids that their rows are given
    names = d.groupBy("doc_id", "_h").agg(F.count("*").alias("copies")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").withColumn("_row", F.monotonically_increasing_id())
    names = _io.keep(names, "rows")
    rows = d.join(names, ["doc_id", "_h"]).select(F.col("_row").alias("doc_id"), "text", "copies")
    rows = rows.where("copies = 1").unionByName(rows.where("copies > 1").dropDuplicates(["doc_id"])).drop("copies")
    return _io.keep(rows, "numbered"), names.select(F.col("_row").alias("doc_id"), F.col("doc_id").alias("named"), "copies"), n.rows


def repeated_spans(d: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """(spans, near): spans (doc_id, start, n, mask) of words whose windows occur earlier; near, the documents (doc_id, text) that may have some.

    d: rows of numbered(), `count` of them. A mask has a bit for each window of the span; null: all. Occurrences are ordered by (doc_id, start); null
    texts have no words.
    """
    spark = d.sparkSession
    _io.ready(spark)
    frequent, known = _frequent(d, count)
    rows = d.mapInArrow(_rows(frequent, known), _ROWS)
    sure = rows.where("known")
    counted = rows.where("not known").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_repeated, _ROWS)
    found = _io.keep((counted.unionByName(sure) if len(known) else counted).drop("known"), "segments")
    # the first place of each distinct segment
    own = found.groupBy("seg", "anchor", "n").agg(F.min(F.struct("doc_id", "start")).alias("at")).select("anchor", "seg", "n", "at.doc_id", "at.start")
    own = _io.keep(own, "own-segments")
    heavy = _io.keep(own.groupBy("anchor").agg(F.sum("n").alias("words")).where(F.col("words") > SHARD_WORDS).select("anchor"), "heavy-anchors")
    n_heavy = heavy.count()
    heavy = F.broadcast(heavy) if n_heavy <= SEND_IDS else heavy
    ids = found.select("doc_id").distinct()
    near = d.join(F.broadcast(ids) if ids.count() <= SEND_IDS else ids, "doc_id", "left_semi")
    near = _io.keep(near, "near-texts")
    again = None
    if n_heavy:
        again = _again(found.join(heavy, "anchor", "left_semi"), near)
        found, own = found.join(heavy, "anchor", "left_anti"), own.join(heavy, "anchor", "left_anti")
    firsts = own.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "seg", "doc_id", "start", "n")).alias("at"))
    words = near.join(firsts, "doc_id").select("text", "at").mapInArrow(_payload, "anchor long, seg long, doc_id long, start int, words binary")
    dealt = words.repartition("anchor").sortWithinPartitions("anchor")
    firsts = _io.keep(dealt.mapInArrow(_shards, "seg long, doc_id long, start int, mask binary").withColumnsRenamed({"doc_id": "d", "start": "s"}), "masks")
    spans = found.join(firsts, "seg")
    first = (F.col("doc_id") == F.col("d")) & (F.col("start") == F.col("s"))
    spans = spans.select("doc_id", "start", "n", F.when(first, F.col("mask")).alias("mask"), first.alias("first"))
    spans = spans.where(~F.col("first") | (F.regexp_replace(F.hex("mask"), "0", "") != "")).drop("first")
    spans = spans if again is None else spans.unionByName(again)
    return _io.keep(spans.dropDuplicates(["doc_id", "start", "n"]), "spans"), near


def _lost(d: DataFrame, count: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of the rows of numbered() that lose words."""
    spans, near = repeated_spans(d, count)
    lists = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "mask")).alias("spans"))
    return near.join(lists, "doc_id").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")


def _renamed(df: DataFrame, names: DataFrame | None) -> DataFrame:
    """Rows of numbered() as the rows that they stand for."""
    if names is None:
        return df
    d = df.join(names, "doc_id").withColumn("doc_id", F.col("named")).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return d.drop("named", "copies", "_copy")


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of the documents that lose words; `kept` joins the words left by one space.

    docs: doc_id, text; other columns are not read. Texts that share a doc_id are documents of their own, in the order of a hash of the text: the first
    occurrence of a window stays, whatever ids come twice. Equal rows (of one id and text) are one document: each gets its result. Null texts have no words; a
    null doc_id takes no part. An empty table gives an empty one.
    """
    d, names, count = numbered(docs)
    return _renamed(_lost(d, count), names)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    d, names, count = numbered(docs)
    cut = _io.keep(_lost(d, count).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")), "cut")
    whole = lambda rows: rows.mapInArrow(_whole, "doc_id long, n_words long, kept_sha256 string")
    # rows without an id take no part: they are only read here
    rest = (docs if names is None else d).select(F.col("doc_id").cast("long"), "text")
    rest = whole(rest).join(cut.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    out = _renamed(cut.unionByName(rest), names)
    if names is not None:
        out = out.unionByName(whole(docs.where("doc_id is null").select(F.col("doc_id").cast("long"), "text")).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256"))
    return out
