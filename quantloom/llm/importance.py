"""Importance resampling towards a target: documents whose word features are likelier in the target than in the corpus are drawn first.

Each document's features fall into buckets. The counts, a sparse matrix of documents by buckets, are written once as blocks of compressed rows; the sums
of its columns give the corpus's distribution, and its product with the buckets' gains gives the documents' weights. Gumbel noise from the document's id
makes the greatest scores a draw by weight without replacement.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _io, _text

BUCKETS = 10_000
#: Percent of the documents of LEAST_WORDS words or more that are drawn.
SHARE, LEAST_WORDS = 25, 20
SEED = 7
#: Bytes of text in a block, about; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Words up to so many bytes are hashed side by side, longer ones each by itself.
LONG_WORD = 64
#: Blocks that a reader of the matrix takes into memory at once, whatever the size of its files.
GROUP_BLOCKS = 4
#: indices (see _index) and counts (32 bits) are little-endian bytes: as arrays, Spark's reader holds twelve bytes a number and more.
BLOCK = "doc_ids array<long>, n_words array<long>, n_features array<long>, indptr array<long>, indices binary, counts binary"
_CRC = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # the table without its constant: _CRC[0] is 0
#: Scores with equal bits above these are counted together first.
COARSE = 8


def crc32s(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """zlib.crc32 of each raw[start:end], going on from the values of `state`."""
    out = np.zeros(len(starts), np.uint32) if state is None else state.copy()
    size = ends - starts
    far = np.flatnonzero(size > LONG_WORD)
    near = np.flatnonzero((size <= LONG_WORD) & (size > 0))
    near = near[np.argsort(-size[near], kind="stable")]
    lengths, at = size[near], starts[near]
    crc = ~out[near]
    n = len(near)
    for j in range(int(lengths[0]) if n else 0):
        n = int(np.searchsorted(-lengths, -j, "left"))  # those longer than j stand first
        crc[:n] = _CRC[(crc[:n] ^ raw[at[:n] + j]) & 0xFF] ^ (crc[:n] >> np.uint32(8))
    out[near] = ~crc
    for k in far.tolist():
        out[k] = zlib.crc32(raw[starts[k] : ends[k]].tobytes(), int(out[k]))
    return out


def _index(buckets: int) -> str:
    """The type of a bucket's number."""
    return "<u2" if buckets <= 1 << 16 else "<i4"


def csr(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """(words, features, indptr, indices, counts) of the rows of a slice: single words and pairs of neighbours, by bucket."""
    lower = _text.LOWER[raw]
    starts, ends, first = _text.words(lower, offsets, _text.NOT_ALNUM)
    n, n_rows = np.diff(first), len(offsets) - 1
    one = crc32s(lower, starts, ends)
    pair = _text.whole(first, 2)
    gap = _CRC[(~one[pair] ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (~one[pair] >> np.uint32(8))  # one space more
    two = crc32s(lower, starts[pair + 1], ends[pair + 1], ~gap)
    row = _text.row_of(first)
    key = np.concatenate((row * buckets + one % buckets, row[pair] * buckets + two % buckets))
    key, counts = np.unique(key, return_counts=True)
    indptr = np.searchsorted(key, np.arange(n_rows + 1) * buckets)
    return n, n + np.maximum(n - 1, 0), indptr, (key % buckets).astype(_index(buckets)), counts.astype("<i4")


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _blocks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, raw, offsets in _io.slices(b.column(1), BLOCK_BYTES):
                n, features, indptr, indices, counts = csr(raw, offsets, buckets)
                ids = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), b.column(0)[i:j])
                cols = [ids, *(_lists(x, pa.int64()) for x in (n, features, indptr)), *(pa.array([x.tobytes()], pa.binary()) for x in (indices, counts))]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in BLOCK.split(", ")])

    return run


def blocks(docs: DataFrame, key: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """The count matrix of docs (key, text), kept as Parquet: a row for each block of documents."""
    _io.ready(docs.sparkSession)
    return _io.keep(docs.select(F.col(key).cast("long"), "text").mapInArrow(_blocks(buckets), BLOCK), "csr", GROUP_BLOCKS, 4 * BLOCK_BYTES)


def _flat(b: pa.RecordBatch, name: str, kind: str) -> Iterator[np.ndarray]:
    for x in b.column(b.schema.get_field_index(name)):
        yield np.frombuffer(x.as_buffer(), kind)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): one dense vector a task, added up by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            for at, n in zip(_flat(b, "indices", _index(buckets)), _flat(b, "counts", "<i4")):
                sums += np.bincount(at, n, buckets).astype(np.int64)  # a block's sums are exact in doubles
        own = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(sums[own])], ["bucket", "n"])

    return matrix.select("indices", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target than in the corpus, each count with one more; both are (bucket, n), of at most `buckets`
    rows."""
    s, t = np.zeros(buckets, object), np.zeros(buckets, object)
    for counts, df in ((s, corpus), (t, target)):
        for r in df.collect():
            counts[r.bucket] = r.n
    of_s, of_t = float(sum(s)) + buckets, float(sum(t)) + buckets
    return np.array([math.floor(1000 * math.log((t[k] + 1.0) * of_s / ((s[k] + 1.0) * of_t))) for k in range(buckets)], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise in thousandths, from the document's id; null is a name of its own."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(matrix: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of a matrix's rows: its product with the gains, over the features."""
    gain = np.asarray(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (at, counts) in enumerate(zip(_flat(b, "indices", _index(len(gain))), _flat(b, "counts", "<i4"))):
                ids, n, features, indptr = (b.column(c)[k].values for c in range(4))
                features, indptr = features.to_numpy(), indptr.to_numpy()
                sums = np.concatenate(([0], np.cumsum(gain[at] * counts)))
                weight = np.where(features > 0, (sums[indptr[1:]] - sums[indptr[:-1]]) // np.maximum(features, 1), 0)
                score = weight + np.array([noise(seed, i) for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, n, pa.array(features), pa.array(weight), pa.array(score)], ["doc_id", "n_words", "n_features", "weight", "score"])

    return matrix.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows with rank: 1, 2, 3 ... by score, then doc_id, of the floor(share * N / 100) first of the N rows with enough words; else null.

    Counts by score give each score's first rank (summed within coarse steps of score, then over those), and only rows of one score are sorted together.
    """
    fit = rows.where(F.col("n_words") >= least_words)
    n = fit.count()
    steps = fit.groupBy("score").agg(F.count("*").alias("_n")).withColumn("_coarse", F.shiftright("score", COARSE))
    above = Window.partitionBy("_coarse").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("_within", F.coalesce(F.sum("_n").over(above), F.lit(0)))
    coarse = steps.groupBy("_coarse").agg(F.sum("_n").alias("_n"))
    before = Window.orderBy(F.desc("_coarse")).rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select("_coarse", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    first = steps.join(coarse, "_coarse").select(F.col("score").alias("_score"), (F.col("_before") + F.col("_within")).alias("_first"))
    in_score = Window.partitionBy("score").orderBy("doc_id")
    order = fit.withColumn("_k", F.row_number().over(in_score)).join(first, F.col("score") == F.col("_score")).withColumn("rank", (F.col("_first") + F.col("_k")).cast("long"))
    order = order.withColumn("rank", F.when(F.col("rank") <= n * share // 100, F.col("rank"))).select(*rows.columns, "rank")
    return order.unionByName(rows.where(~F.coalesce(F.col("n_words") >= least_words, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, *, buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs (doc_id, text); rank is null where a document isn't drawn.

    target: texts (column text). Words are runs of ASCII letters, digits and all beyond ASCII, A-Z as a-z; null and empty texts have none, and weight 0. An
    empty target is all buckets alike, and so is an empty corpus. Rows of one doc_id share their noise, each has its own weight, and rows equal in score and doc_id are
    ranked in any order. Other columns have no part.
    """
    matrix = blocks(docs, buckets=buckets)
    other = blocks(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), buckets=buckets)
    gain = gains(column_sums(matrix, buckets), column_sums(other, buckets), buckets)
    rows = _io.keep(weigh(matrix, gain, seed), "weights")
    _io.drop(matrix)
    _io.drop(other)
    return ranked(rows, share, least_words)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = resample(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return d.select("doc_id", "n_features", "weight", "score", "rank")
