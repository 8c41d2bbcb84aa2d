"""MinHash near-duplicates by an LSH forest.

Each tree of the forest is a sorted order of the documents by a run of their MinHash values (a different run for each tree). Documents next to
each other with a common prefix of DEPTH values or more are a region, and the candidates are the documents of one region. A class of equal
shingle sets is one document.

- The first passes walk a few trees each in sorted order. A region of up to BLOCK_BYTES of shingles is compared whole; a larger one is cut
  where neighbours have their shortest longest common prefix, so that its depth adapts to its size. They cost in proportion to the documents,
  and join most copies.
- The last pass takes all trees, and every pair of documents that a region has in different components: a region within BLOCK_BYTES in one task,
  a larger one by pairs of blocks, a task's group for each. A component over a block's size has blocks of its own, which don't meet each other, so
  that a large group of joined copies costs its own size. Nothing is capped.

A task holds the full shingle sets of its documents, confirms pairs on them, and gives only links that join two components, so that links
grow with the documents whatever the size of a group. Within a group, documents with too few shingles that occur in other components drop out
before any pair is looked at, and sketches of 64 bits before any set is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _io, _text

WORDS = 5
PERCENT = 80  # similarity of linked documents, unless an argument says otherwise
MISS = 1e-6  # chance that all trees miss a pair at the threshold, and that its sketches do, at most
DEPTH = 4  # shortest common prefix of a region
PATH = 8  # values in a tree's sort key
FIRST = ((0, 2), (2, 6))  # trees of each pass in sorted order
SMALL = 12  # documents of a group whose pairs are compared one by one
BLOCK_BYTES = 16 << 20  # of a block of documents: shingles, and ROW_BYTES for each, so that a block of short ones is bounded too
ROW_BYTES = 1000
BITS_BYTES = 64 << 20  # of a group's bit matrix; a larger one's pairs are compared one by one
#: So many ids or regions at most are sent to all executors (about 16 bytes each); more are joined by shuffle.
SEND_IDS = 1_000_000


def trees(percent: int) -> int:
    """So many that a pair at the threshold shares a region but with chance MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - min(percent / 100, 0.99) ** DEPTH))


def sketch_bits(percent: int) -> int:
    """Bits of 64 that the sketches of a pair at the threshold agree in, but with chance MISS. A bit agrees with probability (1 + s) / 2."""
    p, below = (1 + percent / 100) / 2, 0.0
    for k in range(65):
        below += math.comb(64, k) * p**k * (1 - p) ** (64 - k)
        if below > MISS:
            return k
    return 64


def _permutations(n: int) -> np.ndarray:
    return _text.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes, row after row, and where each row's begin (one more entry than rows). Fewer than k words: the whole
    sequence is one shingle; no words: none."""
    raw = _text.LOWER[raw]
    starts, ends, first = _text.words(raw, offsets)
    h = _text.hashes(raw, starts, ends)
    g = _text.grams(h, k)
    parts, at = [], np.zeros(len(first), np.int64)
    for i in range(len(first) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            x = np.sort(g[a : b - k + 1])
            x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:
            x = _text.grams(h[a:b], b - a)
        else:
            x = h[:0]
        parts.append(x)
        at[i + 1] = at[i] + len(x)
    return (np.concatenate(parts) if parts else h[:0]), at


def signatures(sets: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """(rows, n) MinHash values, 32 bits each; an empty set's are all ones."""
    out = np.full((len(at) - 1, n), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        with np.errstate(over="ignore"):
            for j, by in enumerate(_permutations(n)):
                out[full, j] = np.minimum.reduceat((sets * by) >> np.uint64(32), at[full]).astype(np.uint32)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a 2-D array as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    ends = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, ends, pa.py_buffer(rows)])


def _set_ids(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, 2): 128 bits that tell sets apart; an empty set's are zero."""
    full = np.flatnonzero(np.diff(at))
    ids = np.zeros((len(at) - 1, 2), np.uint64)
    if len(full):
        with np.errstate(over="ignore"):
            ids[full, 0] = np.add.reduceat(_text.mix(sets), at[full])
            ids[full, 1] = np.add.reduceat(_text.mix(sets ^ np.uint64(0x5851F42D4C957F2D)), at[full])
    return ids


def _sign(words: int, n_hashes: int) -> Callable:
    """(id, text) -> (id, n_shingles, set_id, signature)"""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, raw, offsets in _io.slices(b.column(1)):
                sets, at = shingle_sets(raw, offsets, words)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(np.diff(at)), _binary(_set_ids(sets, at)), _binary(signatures(sets, at, n_hashes))], ["id", "n_shingles", "set_id", "sig"])

    return sign


def _sets(words: int) -> Callable:
    """(id, text) -> (id, set_id, values), values being the shingle set"""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, raw, offsets in _io.slices(b.column(1)):
                sets, at = shingle_sets(raw, offsets, words)
                values = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(np.ascontiguousarray(at) * 8), pa.py_buffer(sets)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], _binary(_set_ids(sets, at)), values], ["id", "set_id", "values"])

    return sets_of


_NODE = "region long, path long, id long, set_id binary, comp long, n long, sketch long"


def _paths(first: int, last: int, n_hashes: int) -> Callable:
    """(id, set_id, comp, n, sig) -> a row for each tree: region hashes the tree and its first DEPTH values, path is of those after, and the
    sketch has a bit of 64 values."""

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            sig = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint32).reshape(len(b), n_hashes)
            sketch = pa.array(np.packbits((sig[:, :64] & np.uint32(1)).astype(np.uint8), axis=1).view(np.int64).ravel())
            for tree in range(first, last):
                region = np.full(len(b), tree + 1, np.uint64)
                path = np.zeros(len(b), np.uint64)
                for k in range(PATH):
                    value = sig[:, (tree * DEPTH + k) % n_hashes]
                    if k < DEPTH:
                        region = _text.mix(region * np.uint64(0x9E3779B97F4A7C15) + value.astype(np.uint64))
                    else:
                        path = (path << np.uint64(16)) | (value & np.uint32(0xFFFF)).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), pa.array(path.view(np.int64)), *(b.column(k) for k in range(4)), sketch], ["region", "path", "id", "set_id", "comp", "n", "sketch"])

    return paths


class _Joined:
    """Labels of components that grow together."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        """False if they were one."""
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y

    def roots(self) -> np.ndarray:
        up = self.up
        while not np.array_equal(up, up[up]):
            up = up[up]
        self.up = up.copy()
        return up


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _enough(common, nx, ny, percent: int):
    """100 * common >= percent * union"""
    return (100 + percent) * common >= percent * (nx + ny)


def group_links(ids: np.ndarray, comp: np.ndarray, sketch: np.ndarray, block: np.ndarray, sets: list[np.ndarray], percent: int, bits: int) -> list[tuple[int, int]]:
    """Links (id, id) that join the components that any pair of these documents joins. With two blocks, only pairs across them count."""
    across = bool((block != block[0]).any())
    labels, label = np.unique(comp, return_inverse=True)
    joined = _Joined(len(labels))
    n = np.array([len(s) for s in sets])
    out = []
    if len(ids) <= SMALL:
        for i in range(len(ids)):
            for j in range(i + 1, len(ids)):
                if (across and block[i] == block[j]) or not _enough(min(n[i], n[j]), n[i], n[j], percent) or joined.root(label[i]) == joined.root(label[j]):
                    continue
                if int(np.bitwise_count(~(sketch[i] ^ sketch[j]).view(np.uint64))) >= bits and _enough(_overlap(sets[i], sets[j]), n[i], n[j], percent):
                    joined.join(label[i], label[j])
                    out.append((int(ids[i]), int(ids[j])))
        return out
    live, shared, rank = _shared(sets, n, label, percent)
    ids, label, sketch, block, n = ids[live], label[live], sketch[live].view(np.uint64), block[live], n[live]
    if len(live) < 2:
        return out
    top = int(max(r[-1] if len(r) else 0 for r in rank)) + 1
    matrix = _bits(rank, top) if len(live) * (top + 63) // 64 * 8 <= BITS_BYTES else None
    a, step = 0, 1
    while a < len(ids):
        # the first rows are looked at one by one: in a group of copies they join most of it
        b = min(a + step, len(ids))
        root = joined.roots()[label]
        ok = root[a:b, None] != root[None, a:]
        ok &= np.arange(a, b)[:, None] < np.arange(a, len(ids))[None]
        if across:
            ok &= block[a:b, None] != block[None, a:]
        i, j = np.nonzero(ok)
        i, j = i + a, j + a
        ok = _enough(np.minimum(shared[i], shared[j]), n[i], n[j], percent)
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(~(sketch[i] ^ sketch[j])) >= bits
        i, j = i[ok], j[ok]
        for at in range(0, len(i), 4096):
            x, y = i[at : at + 4096], j[at : at + 4096]
            if matrix is None:
                common = np.array([_overlap(rank[p], rank[q]) for p, q in zip(x.tolist(), y.tolist())], np.int64)
            else:
                common = np.bitwise_count(matrix[x] & matrix[y]).sum(axis=1, dtype=np.int64)
            ok = _enough(common, n[x], n[y], percent)
            for p, q in zip(x[ok].tolist(), y[ok].tolist()):
                if joined.join(label[p], label[q]):
                    out.append((int(ids[p]), int(ids[q])))
        a, step = b, min(2 * step, 256, max(1, (4 << 20) // len(ids)))
    return out


def _shared(sets: list[np.ndarray], n: np.ndarray, label: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Documents of which `percent` of the shingles, or more, occur in another component's (until none drops out), how many of theirs do, and
    which, as ranks."""
    live = np.arange(len(sets))
    _, value = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(live, n)
    while True:
        order = np.argsort(value, kind="stable")
        v, of = value[order], label[row[order]]
        starts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
        both = np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts) if len(v) else np.zeros(0, bool)
        size = np.diff(np.append(starts, len(v)))
        kept = np.zeros(len(v), bool)
        kept[order] = np.repeat(both, size)
        rank = np.zeros(len(v), np.int64)
        rank[order] = np.repeat(np.cumsum(both) - 1, size)
        count = np.bincount(row[kept], minlength=len(sets))
        ok = 100 * count[live] >= percent * n[live]
        if ok.all():
            break
        live = live[ok]
        stay = kept & np.isin(row, live)
        value, row = value[stay], row[stay]
    row, rank = row[kept], rank[kept]
    ends = np.searchsorted(row, np.append(live, len(sets)))
    return live, count[live], [np.sort(rank[ends[k] : ends[k + 1]]) for k in range(len(live))]


def _bits(rank: list[np.ndarray], top: int) -> np.ndarray:
    """(rows, words) of bits: that of each rank of a row."""
    out = np.zeros((len(rank), (top + 63) // 64), np.uint64)
    step = max(1, (8 << 20) // max(1, out.shape[1] * 64))
    for a in range(0, len(rank), step):
        part = rank[a : a + step]
        flags = np.zeros((len(part), out.shape[1] * 64), np.uint8)
        flags[np.repeat(np.arange(len(part)), [len(r) for r in part]), np.concatenate(part)] = 1
        out[a : a + step] = np.packbits(flags, axis=1).view(np.uint64)
    return out


def _linked(percent: int, bits: int, block_bytes: int | None) -> Callable:
    """Over rows (region, one, two, block, id, comp, sketch, path, values) sorted by (region, one, two, path): the links of each group (region,
    one, two). With block_bytes a group is cut once its shingles pass that many bytes: where two neighbours' common prefix is shortest."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, size = [], None, 0

        def flush(rows: list) -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                block, ids, comp, sketch, _ = (np.array([r[k] for r in rows], np.int64) for k in range(5))
                if (comp != comp[0]).any():
                    found = group_links(ids, comp, sketch, block, [np.frombuffer(r[5], np.uint64) for r in rows], percent, bits)
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(3))))
            for k, row in zip(keys, zip(*(b.column(c).to_pylist() for c in range(3, 8)), b.column(8).to_pylist())):
                if k != key:
                    yield from flush(held)
                    held, key, size = [], k, 0
                held.append(row)
                size += len(row[5]) + ROW_BYTES
                if block_bytes is not None and size > block_bytes:
                    cut = _cut(np.array([r[4] for r in held], np.int64))
                    yield from flush(held[:cut])
                    held = held[cut:]
                    size = sum(len(r[5]) + ROW_BYTES for r in held)
        yield from flush(held)

    return links


def _cut(path: np.ndarray) -> int:
    """Where to cut sorted paths, from the middle on: after the row with the shortest longest common prefix with its next."""
    x = (path[1:] ^ path[:-1]).view(np.uint64)
    common = sum(((x >> np.uint64(64 - 16 * k)) == 0).astype(np.int64) for k in range(1, PATH - DEPTH + 1)) if len(x) else np.zeros(0, np.int64)
    half = len(path) // 2
    return half + int(np.argmin(common[half - 1 :])) if half else len(path)


def _blocked(rows: DataFrame, size: DataFrame, block_bytes: int) -> DataFrame:
    """The rows of the regions in size (region, bytes), with their block and once for each pair of blocks (one, two) that they are compared in. A region of
    at most block_bytes is one block. In a larger one a component over block_bytes has blocks of its own and all others share blocks; blocks of one
    component don't meet. So a group that is joined already goes out once for each block of the rest, however large it is itself."""
    bytes_of = F.sum(F.col("n") * 8 + ROW_BYTES)
    n_blocks = lambda c: F.ceil(c / F.lit(float(block_bytes))).cast("long")
    sent = lambda df: F.broadcast(df) if df.count() <= SEND_IDS else df
    large = size.where(F.col("bytes") > block_bytes).select("region")
    own = rows.join(sent(large), "region", "left_semi").groupBy("region", "comp").agg(bytes_of.alias("own_bytes")).where(F.col("own_bytes") > block_bytes)
    # a region has no more such components than its bytes have blocks
    before = Window.partitionBy("region").orderBy("comp").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("n_own", n_blocks(F.col("own_bytes"))).withColumn("place", F.coalesce(F.sum("n_own").over(before), F.lit(0)))
    own = _io.keep(own, "large-components")
    owned = own.groupBy("region").agg(F.sum("n_own").alias("owned"), F.sum("own_bytes").alias("owned_bytes"))
    size = size.join(sent(owned), "region", "left").select("region", n_blocks(F.col("bytes") - F.coalesce("owned_bytes", F.lit(0))).alias("shared"), F.coalesce("owned", F.lit(0)).alias("owned"))
    at = rows.join(sent(size), "region").join(sent(own.select("region", "comp", "n_own", "place")), ["region", "comp"], "left")
    spread = F.xxhash64("set_id", "region")
    at = at.withColumn("start", F.col("shared") + F.col("place"))
    at = at.withColumn("block", F.when(F.col("n_own").isNull(), F.pmod(spread, F.greatest("shared", F.lit(1)))).otherwise(F.col("start") + F.pmod(spread, F.greatest("n_own", F.lit(1)))))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("shared") + F.col("owned") - 1), lambda b: F.col("n_own").isNull() | (b < F.col("start")) | (b >= F.col("start") + F.col("n_own")))
    at = at.withColumn("with", F.explode(others))
    return at.withColumn("one", F.least("block", "with")).withColumn("two", F.greatest("block", "with"))


def _links(texts: DataFrame, near: DataFrame, span: tuple[int, int], last: bool, percent: int, words: int, block_bytes: int) -> DataFrame:
    """Confirmed links (a, b) of documents in a common region of the trees `span`, between components that none joined so far."""
    n_hashes = trees(percent) * DEPTH
    rows = near.select("id", "set_id", "comp", "n", "sig").mapInArrow(_paths(*span, n_hashes), _NODE)
    size = rows.groupBy("region").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.sum(F.col("n") * 8 + ROW_BYTES).alias("bytes")).where("c0 < c1")
    size = _io.keep(size.select("region", "bytes"), "regions")
    if last:
        at = _blocked(rows, size, block_bytes)
    else:
        at = rows.join(F.broadcast(size) if size.count() <= SEND_IDS else size, "region")
        at = at.select("*", *(F.lit(0).cast("long").alias(c) for c in ("block", "one", "two")))
    at = _io.keep(at.select("region", "one", "two", "block", "id", "comp", "sketch", "path", "set_id"), "open")
    wanted = at.select("id").distinct()
    wanted = F.broadcast(wanted) if at.count() <= SEND_IDS else wanted
    sets = texts.join(wanted, "id", "left_semi").mapInArrow(_sets(words), "id long, set_id binary, values binary")
    sets = sets.groupBy("id", "set_id").agg(F.first("values").alias("values"))
    full = at.join(sets, ["id", "set_id"]).select("region", "one", "two", "block", "id", "comp", "sketch", "path", "values")
    if last:
        full = full.repartition("region", "one", "two").sortWithinPartitions("region", "one", "two")
    else:
        full = full.repartitionByRange("region", "path", "id").sortWithinPartitions("region", "one", "two", "path", "id")
    found = full.mapInArrow(_linked(percent, sketch_bits(percent), None if last else block_bytes), "a long, b long")
    out = _io.keep(found.distinct(), "links")
    _io.drop(size)
    _io.drop(at)
    return out


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the least id that each id of the links (a, b) reaches. Large-star and small-star steps by turns, until no edge changes. The
    minimum of a hub's neighbours is combined before the shuffle; the join back to them is split by AQE where a hub has very many."""
    edges = _io.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        # large star: a node's greater neighbours move to its least neighbour or itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its lesser neighbours move to the least of these
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = _io.keep(small, "edges")
        _io.drop(edges)
        edges = after
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("comp"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", percent: int = PERCENT, words: int = WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of each row of docs (id_col, text). Documents are linked if 100 * intersection of their sets of
    shingles of `words` words >= percent * union.

    Rows of one id are one document, linked to whatever any of its texts is; a null id stands for itself alone, with a null component_id
    and kept true. Null texts and texts without words have no shingles and link to nothing. Texts of equal shingle sets are one class; only
    its least id is compared. An empty table gives an empty one. Other columns, of whatever name, are not read.
    """
    _io.ready(docs.sparkSession)
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), "text")
    n_trees = trees(percent)
    signed = _io.keep(named.mapInArrow(_sign(words, n_trees * DEPTH), "id long, n_shingles long, set_id binary, sig binary"), "signed")
    full = signed.where("n_shingles > 0 and id is not null")
    own = full.groupBy("set_id").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    reps = _io.keep(own.select("set_id", "id", "n", "sig"), "reps")
    # ids with several texts: their classes are linked, by the id itself
    several = signed.where("id is not null").groupBy("id").agg(F.min("set_id").alias("s0"), F.max("set_id").alias("s1")).where("s0 <> s1").select("id")
    several = _io.keep(several, "several")
    n_several = several.count()
    several_of = F.broadcast(several) if n_several <= SEND_IDS else several
    links = full.join(several_of, "id", "left_semi").join(reps.select("set_id", F.col("id").alias("rep")), "set_id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    links = _io.keep(links.distinct(), "links")
    parts, texts = [links], named.where("id is not null")
    near = reps.withColumn("comp", F.col("id"))
    for span in (*FIRST, (0, n_trees)):
        last = span == (0, n_trees)
        more = _links(texts, near, span, last, percent, words, block_bytes)
        parts.append(more)
        links = links.unionByName(more)
        comp = _io.keep(components(links), "components")
        near = reps.join(comp, "id", "left").select("set_id", "id", "n", "sig", F.coalesce("comp", "id").alias("comp"))
    classes = near.select("set_id", "comp")
    some = signed.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_id")).alias("set_id"))
    out = some.join(classes, "set_id", "left").select("id", "n_shingles", "comp")
    if n_several:
        out = out.join(comp.join(several_of, "id", "left_semi").withColumnRenamed("comp", "c"), "id", "left").select("id", "n_shingles", F.coalesce("c", "comp").alias("comp"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(f"`{id_col}`") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """docs without the near-duplicates of a document of lesser id; all columns stay. Of rows with one id and one text, one stays; other texts of an id that
    stays are that document's, and stay too."""
    rows = _io.keep(near_duplicates(docs, id_col=id_col, percent=percent).select(id_col, "kept"), "near-kept")
    out = _io.keep(rows.where("not kept").select(id_col).distinct(), "near-duplicates")
    left = docs.join(F.broadcast(out) if out.count() <= SEND_IDS else out, id_col, "left_anti")
    again = _io.keep(rows.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col), "repeated-ids")
    n = again.count()
    if not n:
        return left
    again = F.broadcast(again) if n <= SEND_IDS else again
    packed = _io.pack(left, [id_col, "text"]).withColumn("_h", F.xxhash64("text"))  # only rows of ids that come twice are shuffled
    once = packed.join(again, id_col, "left_semi").dropDuplicates([id_col, "_h"]).select(*_io.unpack(left, left.columns, [id_col, "text"]))
    return left.join(again, id_col, "left_anti").unionByName(once)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), percent=85)
