"""Mixing sources to target weights: weighted sampling without replacement, to a budget of words for each source.

DataFrame functions only. A document's key is -ln(u) / weight (Efraimidis and Spirakis), u a hash of its doc_id; a source takes
complete epochs first, then the documents of least key until its budget is met, the last of them in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _io

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
WORD = r"[^\x20\x09-\x0D]+"
#: Documents in a bucket of keys, about: the most that a source sorts in one task.
BUCKET_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Symbols of the quality rules, and the least weight that a document has.
SYMBOLS = r"[#*$%&|<>]"
LEAST_WEIGHT = 0.01


def quality(text: Column, size: Column) -> Column:
    """The share of the text's lines that are its own, by the share of its words left if each symbol spoils one, by how near the mean word's length is to that
    of prose (5 characters and a space): between LEAST_WEIGHT and 1."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    own = F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))
    words = F.greatest(size, F.lit(1))
    clean = 1 - F.least(F.regexp_count(text, F.lit(SYMBOLS)) / words, F.lit(1.0))
    mean = F.length(text) / words
    return F.greatest(own * clean * F.least(mean / 6, 6 / mean), F.lit(LEAST_WEIGHT))


def uniform(*parts: Column) -> Column:
    """In (0, 1], from the first 52 bits of an MD5 of the parts; null has a place of its own."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 1) / F.lit(float(2**52))


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Targets of (source, source_size, source_rows): share of all sizes by weight, `cap` times a source's size at most.

    What exceeds a cap goes to the others by weight until none exceeds its own. That settles at target = min(cap * size, level * weight);
    with the sources in order of cap * size / weight, the level follows from running sums. One row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    values = F.array(*[F.lit(float(w)) for w in weights])
    t = totals.withColumn("w", F.element_at(values, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    up = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    t = t.withColumn("capped", F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("left_w", F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.col("capped")) / F.col("left_w"))
    # the level that holds is the first that no later source's cap is under
    t = t.withColumn("holds", F.min(F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct(F.col("most") / F.col("w"), "level"))).over(every))
    target = F.least("most", F.col("w") * F.coalesce(F.col("holds.level"), F.lit(float("inf"))))
    return t.select("source", "source_size", "source_rows", target.alias("target"))


RESULTS = ("_size", "_source_size", "_target", "_copies", "_part")


def mix(docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 0, weight=quality) -> DataFrame:
    """docs with _size, _source_size, _target, _copies (whole ones) and _part (words of one more, cut copy).

    docs: doc_id, text, source and any other columns, which stay; `weight` gives a document's quality weight from (text, size).
    Null texts have size 0 and are never taken; a null source is a source. Equal keys are told apart by doc_id, size and text, and what is
    still equal is one row as good as another. An empty table gives an empty one. The text is read twice: for the totals and key counts,
    and for the result. Only documents in the one bucket of keys that a source's budget ends in are sorted. Columns with the name of a result
    give way to it.
    """
    used = ["doc_id", "text", "source"]
    d = _io.pack(docs, used, RESULTS).withColumn("_size", word_count(F.col("text")))
    key = F.when(F.col("_size") > 0, F.log(-F.log(uniform(F.lit(seed), F.col("doc_id")) * (1 - 2**-52)) / weight(F.col("text"), F.col("_size"))))
    d = d.withColumn("_key", key)
    # (source, size, key) without texts; what follows counts it twice
    narrow = _io.keep(d.select("source", "_size", "_key"), "mix-keys")
    totals = narrow.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("source_rows"))
    plan = _io.keep(targets(totals, weights, share, cap), "mix-targets")
    plan = plan.withColumn("_budget", F.round("target").cast("long"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("_budget") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("_epochs", whole.cast("long")).withColumn("_rest", F.col("_budget") - F.col("_epochs") * F.col("source_size"))
    steps = F.ceil(F.col("source_rows") / F.lit(float(BUCKET_ROWS)))
    bucket = F.floor(F.col("_key") * steps).cast("long")
    sources = _bounded(plan.select("source", "source_rows", "_rest"))
    at = narrow.join(sources, narrow.source.eqNullSafe(sources.source)).select(sources.source, "_rest", "_size", bucket.alias("_bucket"))
    counts = at.where("_size > 0").groupBy("source", "_rest", "_bucket").agg(F.sum("_size").alias("n"))
    run = Window.partitionBy("source").orderBy("_bucket")
    counts = counts.withColumn("_under", F.sum("n").over(run) - F.col("n"))
    edge = counts.where("_under <= _rest and _rest < _under + n").select(F.col("source").alias("_s"), F.col("_bucket").alias("_edge"), "_under")
    plan = _io.keep(plan.join(edge, plan.source.eqNullSafe(edge._s), "left").drop("_s"), "mix-plan").withColumnRenamed("source", "_source")
    plan = _bounded(plan)
    out = d.join(plan, d.source.eqNullSafe(plan._source)).withColumn("_bucket", bucket)
    clear = out.where("not (_size > 0 and _bucket <=> _edge)")
    clear = clear.withColumn("_part", F.when((F.col("_size") > 0) & (F.col("_bucket") < F.col("_edge")), F.col("_size")).otherwise(F.lit(0).cast("long")))
    close = out.where("_size > 0 and _bucket <=> _edge")
    order = Window.partitionBy("_source").orderBy("_key", "doc_id", "_size", F.xxhash64("text"))
    left = F.col("_rest") - F.col("_under") - (F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
    close = close.withColumn("_part", F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), left)))
    both = clear.unionByName(close)
    both = both.withColumn("_copies", F.when(F.col("_size") > 0, F.col("_epochs") + (F.col("_part") == F.col("_size")).cast("long")).otherwise(F.lit(0).cast("long")))
    both = both.withColumn("_part", F.when(F.col("_part") == F.col("_size"), F.lit(0).cast("long")).otherwise(F.col("_part")))
    return both.select(*_io.unpack(both, docs.columns, used, RESULTS), "_size", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_copies", "_part")


#: A table of so many rows at most, each of a source's name and a few numbers, is sent to all executors; a larger one is joined by shuffle.
SEND_ROWS = 20_000


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SEND_ROWS else df


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: each document as often as it is taken. The one that a source's budget ends in goes whole if half
    of it or more is within, else not."""
    used = ["doc_id", "text", "source"]
    m = mix(_io.pack(docs, used), **options)
    copies = F.col("_copies") + ((F.col("_part") > 0) & (2 * F.col("_part") >= F.col("_size"))).cast("long")
    m = m.withColumn("_n", copies).where("_n > 0").withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return m.select(*_io.unpack(docs, docs.columns, used))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    taken = F.col("_copies") * F.col("_size") + F.col("_part")
    return m.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"))
