"""Sharding by rendezvous hashing: each record goes to the shard of highest score, a hash of its key and the shard.

DataFrame functions only. A shard added takes the records that it now scores highest for, and no other record moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _io
from .mixing import uniform

SHARDS = 8
#: Records in a bucket of hashed keys, about: the most that are numbered in one sort.
BUCKET_ROWS = 50_000


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard i with the highest -weights[i] / ln(u(key, i)); the lowest such i."""
    scores = [F.struct((F.lit(float(w)) / -F.log(uniform(key, F.lit(i)) * (1 - 2**-53))).alias("score"), F.lit(-i).alias("i")) for i, w in enumerate(weights) if w > 0]
    if not scores:
        raise ValueError("a shard needs a weight above 0")
    return (-(F.greatest(*scores) if len(scores) > 1 else scores[0]).getField("i")).cast("int")


def shard(docs: DataFrame, *, key: str = "doc_id", weights: Sequence[float] = (1.0,) * SHARDS, grown: Sequence[float] | None = None, names: Sequence[str | None] = ("_shard", "_grown_shard", "_slot")) -> DataFrame:
    """docs with _shard, _grown_shard (under `grown`, by default one more shard of the last weight) and _slot, gapless from 0 in each shard.
    `names` are theirs; a column without one is left out.

    A null key is a key of its own; equal keys share a shard. Slots follow a hash of the whole row; equal rows are numbered in any order.
    They are numbered in buckets of that hash, with offsets from the buckets' counts, so no shard is sorted as a whole and a key that many
    rows share is dealt out too. An empty table gives an empty one; other columns stay, but for ones of the names that `names` gives the
    three.
    """
    grown = [*weights, weights[-1]] if grown is None else grown
    packed = _io.pack(docs, [key])
    rest = [F.col(f"_others.`{c}`") for c, kind in docs.dtypes if c != key and "map<" not in kind]
    d = packed.withColumns({"_h": F.xxhash64(key, *rest), "_shard": shard_of(F.col(key), weights), "_grown_shard": shard_of(F.col(key), grown)})
    buckets = max(1, -(-docs.count() // (BUCKET_ROWS * len(weights))))
    out = _numbered(d, buckets)
    made = [F.col(c).alias(n) for c, n in zip(("_shard", "_grown_shard", "_slot"), names) if n]
    return out.select(*_io.unpack(out, [c for c in docs.columns if not _io.named(c, names)], [key]), *made)


def _numbered(d: DataFrame, buckets: int) -> DataFrame:
    d = d.withColumn("_bucket", F.pmod(F.col("_h"), F.lit(buckets)))
    sizes = d.groupBy("_shard", "_bucket").count()
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_shard", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("_shard", "_bucket").orderBy("_h")
    return d.withColumn("_rank", F.row_number().over(order)).join(sizes, ["_shard", "_bucket"]).withColumn("_slot", (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_before", "_rank")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    d = docs.select("doc_id", (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    d = _io.keep(d, "shard-records")
    d = shard(d)
    return d.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.col("_grown_shard").alias("grown_shard"))
