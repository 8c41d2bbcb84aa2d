"""URL filters: rules and lists of hosts, looked up in a Bloom filter cascade.

DataFrame functions only. The first level of a cascade encodes the listed keys; the second those keys of the corpus that the first holds to be listed and
aren't; the third the listed keys that the second holds; and so on until no key is wrong. A key's answer is the first level that doesn't hold it. Levels
are built from every key of the corpus, so membership is exact for all of them, and pages are judged where they are read: no join, no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io

#: Verdict, host and path of the rules; a rule holds for its host, all subdomains, and paths that begin with its own.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words of host names, between dots and hyphens, that put a host on the list of blocked ones.
TERMS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam")
#: Listed keys in one cascade, which is sent to all tasks with the plan (about 2.5 bytes a key); a longer list is taken in parts, a pass for each.
MOST_LISTED = 2_000_000
#: Bits in one row of a level's bitmap: a fixed value of bitmap_construct_agg.
ROW_BITS = 32_768
RESULTS = ("_host", "_path", "_rule", "_verdict")


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its place in the cascade, bits, hash functions and bytes."""

    seed: int
    bits: int
    hashes: int
    data: bytes = b""

    def positions(self, key: Column) -> list[Column]:
        """Two halves of a hash that depends on the level, combined: h1 + j * h2 modulo the bits."""
        h = F.xxhash64(F.lit(self.seed), key)
        low, high = h.bitwiseAND(0x7FFFFFFF), F.shiftrightunsigned(h, 33).bitwiseOR(F.lit(1))
        return [F.pmod(low + j * high, F.lit(self.bits)) for j in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        """Whether all of the key's bits are set."""
        out = F.lit(True)
        for p in self.positions(key):
            byte = F.substring(F.lit(self.data), F.floor(p / 8).cast("int") + 1, F.lit(1))
            out = out & (F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), F.pmod(p, F.lit(8)).cast("int")) == 1)
        return out

    def filled(self, keys: DataFrame) -> Level:
        """This level with the bits of keys.key; partial bitmaps are made where the keys are."""
        at = keys.select(F.explode(F.array(*self.positions(F.col("key")))).alias("p"))
        rows = at.groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("bits"))
        data = bytearray(-(-self.bits // ROW_BITS) * ROW_BITS // 8)
        for r in rows.toLocalIterator():
            data[(r.row - 1) * ROW_BITS // 8 : r.row * ROW_BITS // 8] = r.bits
        return Level(self.seed, self.bits, self.hashes, bytes(data[: -(-self.bits // 8)]))


class Cascade:
    """Levels in order; contains() is exact for the keys that they were built from."""

    def __init__(self, levels: Sequence[Level]):
        self.levels = tuple(levels)

    def contains(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)  # held by all: of the side that the last level encodes
        for i, level in reversed(list(enumerate(self.levels))):
            out = F.when(level.holds(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def build(keys: DataFrame, most: int = MOST_LISTED) -> list[Cascade]:
    """Cascades of (key, listed), which has every key that will be asked for, in any number of rows; listed wherever one of them is. Null keys have no part.

    One cascade for each `most` listed keys: a key is listed where any of them contains it. No listed keys: no cascade.
    """
    keys = _io.keep(keys.where("key is not null").groupBy("key").agg(F.max("listed").alias("listed")), "url-keys")
    parts = -(-keys.where("listed").count() // most)
    own = F.pmod(F.xxhash64(F.lit(-1), "key"), F.lit(max(parts, 1)))
    out = [_cascade(keys.select("key", (F.col("listed") & (own == p)).alias("listed"))) for p in range(parts)]
    _io.drop(keys)
    return out


def _cascade(left: DataFrame) -> Cascade:
    levels, kept = [], []
    while True:
        n = {r.listed: r.n for r in left.groupBy("listed").agg(F.count("*").alias("n")).collect()}
        side = len(levels) % 2 == 0
        if not n.get(side):
            break
        # the first level passes few of the many keys that aren't listed; all later ones about half
        passes = min(0.5, max(n[side] / (n.get(not side, 0) * math.sqrt(2) or 1.0), 1e-6)) if not levels else 0.5
        hashes = max(1, round(-math.log2(passes)))
        level = Level(len(levels), max(64, math.ceil(n[side] * hashes / math.log(2))), hashes).filled(left.where(F.col("listed") == F.lit(side)))
        levels.append(level)
        left = _io.keep(left.where((F.col("listed") == F.lit(side)) | level.holds(F.col("key"))), "url-level")
        kept.append(left)
    for d in kept:
        _io.drop(d)
    return Cascade(levels)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without one."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(F.substring(rest, F.length(F.regexp_extract(rest, "^[^/?#]*", 0)) + 1, F.length(rest)), "^[^?#]*", 0), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def _fitting(host: Column, path: Column, labels: int, lengths: Sequence[int]) -> Column:
    """All keys (host and path in one) of rules that could fit: the host's last 1 to `labels` labels, and the path's beginnings of the rules' lengths."""
    hosts = F.array(*[F.substring_index(host, ".", -k) for k in range(1, labels + 1)])
    paths = F.transform(F.array(*[F.lit(int(n)) for n in lengths]), lambda n: F.substring(path, F.lit(1), n))
    return F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p)))))


def judge(pages: DataFrame, *, rules: DataFrame | Sequence = RULES, listed: DataFrame | None = None, most: int = MOST_LISTED) -> DataFrame:
    """pages with _host, _path, _rule (the longest that fits, as host and path in one, else null) and _verdict (allow or block).

    pages: url, and any other columns, which stay but for ones with a result's name. rules: (verdict, host, path); of two with one host and path, block wins;
    a null path fits all. listed: hosts (column host) that are blocked where no rule fits; null: none. Null urls, and ones without ://, have an empty host and
    path, which no rule fits. Repeated rows each get their result; an empty table gives an empty one.

    All keys of the pages (hosts, and what rules could fit them) are gathered once, distinct by partial sums, to build the cascade.
    """
    spark = pages.sparkSession
    rules = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    rules = _io.keep(rules.select("verdict", "host", F.coalesce("path", F.lit("")).alias("path")).where("host is not null"), "url-rules")
    shape = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    labels, lengths = shape.labels or 1, shape.lengths or [0]
    d = _io.pack(pages, ["url"], RESULTS).withColumns({"_host": host_of(F.col("url")), "_path": path_of(F.col("url"))})
    fits = _fitting(F.col("_host"), F.col("_path"), labels, lengths)
    tagged = lambda tag, c: F.concat(F.lit(tag), c)  # noqa: E731  one cascade for three lists: a: and b: of rules, h: of hosts
    asked = F.concat(F.transform(fits, lambda c: tagged("a:", c)), F.transform(fits, lambda c: tagged("b:", c)), F.array(tagged("h:", F.col("_host"))))
    keys = d.select(F.explode(asked).alias("key"), F.lit(False).alias("listed"))
    keys = keys.unionByName(rules.select(F.concat(F.when(F.col("verdict") == "block", "b:").otherwise("a:"), "host", "path").alias("key"), F.lit(True).alias("listed")))
    if listed is not None:
        keys = keys.unionByName(listed.where("host is not null").select(tagged("h:", F.col("host")).alias("key"), F.lit(True).alias("listed")))
    d = d.withColumns({"_fits": fits, "_hits": F.lit(None).cast("array<string>")})
    cascades = build(keys, most)
    for k, cascade in enumerate(cascades):
        hits = F.filter(asked, cascade.contains)
        d = d.withColumn("_hits", F.concat(F.coalesce("_hits", F.array().cast("array<string>")), hits))
        if k < len(cascades) - 1:
            d = _io.keep(d, "url-hits")
    hits = F.coalesce("_hits", F.array().cast("array<string>"))
    of_rules = F.filter(hits, lambda c: ~c.startswith("h:"))
    # the longest; of one length and name b: is after a:, so block wins
    best = F.array_max(F.transform(of_rules, lambda c: F.struct(F.length(c).alias("n"), F.substring(c, F.lit(3), F.length(c)).alias("rule"), F.substring(c, F.lit(1), F.lit(1)).alias("tag"))))
    d = d.withColumn("_best", best)
    by_list = F.when(F.exists(hits, lambda c: c.startswith("h:")), "block").otherwise("allow")
    verdict = F.when(F.col("_best").isNull(), by_list).when(F.col("_best.tag") == "b", "block").otherwise("allow")
    return d.select(*_io.unpack(d, pages.columns, ["url"], RESULTS), "_host", "_path", F.col("_best.rule").alias("_rule"), verdict.alias("_verdict"))


def spam_hosts(pages: DataFrame, terms: Sequence[str] = TERMS) -> DataFrame:
    """The distinct hosts of pages with one of the terms in their name."""
    return pages.select(host_of(F.col("url")).alias("host")).where(F.col("host").rlike(rf"(^|[.-])({'|'.join(terms)})([.-]|$)")).distinct()


def allowed(pages: DataFrame, **options) -> DataFrame:
    """pages without the blocked ones; the others as they are."""
    d = judge(_io.pack(pages, ["url"]), **options).where("_verdict = 'allow'")
    return d.select(*_io.unpack(d, pages.columns, ["url"]))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    d = judge(pages, listed=spam_hosts(pages))
    return d.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))
