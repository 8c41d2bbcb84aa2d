"""The count matrix of a task is read in parts, however much text the task had."""

import zlib
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quantloom.llm import _io, importance
from test_operators import A, low, table


def features(text, buckets):
    w = A.findall(low(text))
    return Counter(zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def sums(matrix, buckets):
    return {r.bucket: r.n for r in importance.column_sums(matrix, buckets).collect()}


def test_a_task_of_many_blocks_is_read_in_parts(spark):
    text = "concat_ws(' ', transform(sequence(1, 20000), k -> concat('w', (k * 31 + id * 7) % 9973)))"
    docs = spark.range(0, 90, 1, 1).select(F.col("id").alias("doc_id"), F.expr(text).alias("text"))
    matrix = importance.blocks(docs)
    files = matrix.inputFiles()
    assert len(files) == 1
    meta = pq.read_metadata(files[0].removeprefix("file://"))
    groups = [meta.row_group(k) for k in range(meta.num_row_groups)]
    assert sum(g.num_rows for g in groups) == matrix.count() >= 10  # blocks
    assert max(g.num_rows for g in groups) <= 4 and max(g.total_byte_size for g in groups) < 16 << 20  # one group of all blocks before
    rows = importance.weigh(matrix, range(importance.BUCKETS)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(90))
    want = Counter()
    for i, t in table(docs):
        own = features(t, importance.BUCKETS)
        want.update(own)
        r = next(r for r in rows if r.doc_id == i)
        assert (r.n_words, r.n_features, r.weight) == (20_000, 39_999, sum(k * c for k, c in own.items()) // 39_999)
    assert sums(matrix, importance.BUCKETS) == want


def test_more_buckets_than_16_bits(spark, edge):
    matrix, want = importance.blocks(edge, buckets=100_000), Counter()
    for _, t in table(edge):
        want.update(features(t, 100_000))
    assert max(want) > 1 << 16 and sums(matrix, 100_000) == want
    weights = {(r.doc_id, r.n_features): r.weight for r in importance.weigh(matrix, range(100_000)).collect()}
    for i, t in table(edge):
        own = features(t, 100_000)
        n = sum(own.values())
        assert weights[i, n] == (sum(k * c for k, c in own.items()) // n if n else 0)


def test_batches_of_one_kept_table_can_be_smaller(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    texts = spark.range(0, 900, 1, 1).select(F.repeat(F.col("id").cast("string"), 5000).alias("text"))
    small = [r.n for r in _io.keep(texts.mapInArrow(sizes, "n long"), "test", batch_bytes=1 << 20).collect()]
    assert len(small) > 9 and max(small) < 2 << 20
    assert len(_io.keep(texts.mapInArrow(sizes, "n long"), "test").collect()) == 1
