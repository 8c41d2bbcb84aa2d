"""Quality rules with risk-controlled thresholds.

Each rule rejects documents whose statistic is over a cutoff, one cutoff for each stratum. Labelled documents, one of each equal text, are
halved by a hash of the text. One half proposes a cutoff for each rule and the order of the rules, most telling first. The other half decides
how many of them hold: going through the rules in that order, the first k hold together while an exact binomial test says that all of them
reject at most RISK of the stratum's good documents; the first k that fails ends the sequence. So a stratum's rules need no correction among
themselves, and DELTA is shared by the strata (Bonferroni): with chance 1 - DELTA the verdict rejects at most RISK of the good documents of
any stratum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io, _text

MIN_WORDS = 50
REPEAT = 3
RISK = 0.01
DELTA = 0.05
#: A rule that rejects less of a stratum's bad documents, or not so many more of them than of the good, isn't used there.
LEAST_CAUGHT = 0.02
BETTER = 10.0
#: Statistics are counted in 1000ths up to this; beyond, a bin is a 1000th part wide.
FINE = 20_000
#: So many rows of cutoffs at most (a few numbers each) are sent to all executors; more are joined by shuffle.
SEND_ROWS = 20_000

#: Each rule's statistic: 1000 * numerator / denominator.
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "shouting": ("n_upper", "word_chars"),
    "marks": ("n_marks", "n_words"),
    "short_words": ("n_words", "word_chars"),
    "long_words": ("word_chars", "n_words"),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")

_SYMBOL, _MARK, _UPPER, _LINE = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK[list(b"!?")] = True
_UPPER[0x41:0x5B] = True
_LINE[0x0A] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _again(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): the order that brings equal (row, h) together, and whether an entry of it equals the one before."""
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    return order, np.concatenate(([False], (r[1:] == r[:-1]) & (x[1:] == x[:-1]))) if len(h) else np.zeros(0, bool)


def counts(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """COUNTS of each row."""
    starts, ends, first = _text.words(raw, offsets)
    h = _text.hashes(raw, starts, ends)
    word_chars = _per_row(~_text.SPACES[raw] & ((raw & 0xC0) != 0x80), offsets)
    ls, le, lf = _text.words(raw, offsets, _LINE)
    dark = np.concatenate(([0], np.cumsum(~_text.SPACES[raw])))
    full = dark[le] > dark[ls]
    ls, le, row = ls[full], le[full], _text.row_of(lf)[full]
    order, same = _again(row, _text.hashes(raw, ls, le))
    rows = len(offsets) - 1
    dup = np.bincount(row[order][same], minlength=rows)
    at = _text.whole(first, REPEAT)
    again = np.zeros(len(h) + 1, np.int64)
    if len(at):
        order, same = _again(_text.row_of(first)[at], _text.grams(h, REPEAT)[at])
        twice = same | np.append(same[1:], False)
        hit = at[order[twice]]
        np.add.at(again, hit, 1)
        np.add.at(again, hit + REPEAT, -1)
    repeated = _per_row(np.cumsum(again[:-1]) > 0, first)
    return [np.diff(first), word_chars, _per_row(_SYMBOL[raw], offsets), dup, repeated, np.bincount(row, minlength=rows), _per_row(_UPPER[raw], offsets), _per_row(_MARK[raw], offsets)]


def _count(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, raw, offsets in _io.slices(b.column(k)):
                yield pa.RecordBatch.from_arrays([*(b.column(c)[i:j] for c in range(k)), *(pa.array(x.astype(np.int64)) for x in counts(raw, offsets))], names)

    names = [*map(str, range(k)), *COUNTS]
    return run


RESULTS = (*COUNTS, "base_failed", "failed", "kept")


def features(docs: DataFrame) -> DataFrame:
    """docs' columns but the text, COUNTS and base_failed. Null texts count as empty. Columns with the name of a result give way to it."""
    _io.ready(docs.sparkSession)
    d = _io.pack(docs, ["text"], RESULTS).select("_others", "text")
    out = d.mapInArrow(_count(1), _io.schema(d, ["_others"], ", ".join(f"{c} long" for c in COUNTS)))
    out = out.select(*_io.unpack(out, docs.columns, [], ("text", *RESULTS)), *COUNTS)
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def statistic(rule: str) -> F.Column:
    a, b = RULES[rule]
    x = 1000 * F.col(a) / F.greatest(F.col(b), F.lit(1))
    return F.when(x < FINE, F.floor(x)).otherwise(FINE + F.floor(1000 * F.log(x / FINE))).cast("long")


def tail(k: int, n: int, p: float) -> float:
    """P(at most k of n), each with chance p."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    lg = np.array([math.lgamma(x + 1) for x in range(k + 1)])
    rest = np.array([math.lgamma(n - x + 1) for x in range(k + 1)])
    return float(np.exp(math.lgamma(n + 1) - lg - rest + i * math.log(p) + (n - i) * math.log1p(-p)).sum())


def proposal(values: np.ndarray, good: np.ndarray, bad: np.ndarray, risk: float) -> tuple[int, int, int] | None:
    """(cutoff, good and bad documents over it) for a histogram (values ascending, good and bad documents at each); None if none is worth it.

    Of the cutoffs that at most half of the risk exceeds, the laxest that rejects 99% of the bad documents that the strictest does.
    """
    n_good, n_bad = int(good.sum()), int(bad.sum())
    held = []
    over_good = over_bad = 0
    for v, g, b in zip(values[::-1].tolist(), good[::-1].tolist(), bad[::-1].tolist()):
        over_good, over_bad = over_good + g, over_bad + b  # what the cutoff v - 1 rejects
        if not n_good or over_good > risk / 2 * n_good:
            break
        held.append((v - 1, over_good, over_bad))
    held = [x for x in held if x[2] >= LEAST_CAUGHT * n_bad and x[2] * n_good >= BETTER * x[1] * n_bad and x[2]]
    if not held:
        return None
    most = max(x[2] for x in held)
    return next(x for x in held if x[2] >= 0.99 * most)


def holding(n_good: int, rejected: list[int], risk: float, delta: float) -> int:
    """How many of the rules hold: rejected[k] of n_good good documents are rejected by the rule k and by none before."""
    total = 0
    for k, n in enumerate(rejected):
        total += n
        if not n_good or tail(total, n_good, risk) > delta:
            return k
    return len(rejected)


def cutoffs(counted: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, limits) of counted documents (id, stratum, copy: a hash of the text, COUNTS, base_failed), limits being a map of rules to cutoffs.
    labels: (doc_id, quality); one bad label of a text makes it bad. Documents that fail the base rules have no part."""
    known = labels.where("quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"))
    d = counted.where("not base_failed").join(known, "id")
    d = d.groupBy("stratum", "copy").agg((F.min("quality") > 0).alias("good"), *(F.first(c).alias(c) for c in COUNTS))
    d = _io.keep(d.select("stratum", "good", (F.pmod(F.xxhash64("copy"), F.lit(2)) == 0).alias("proposes"), *(statistic(r).alias(r) for r in RULES)), "quality-labelled")
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in RULES]))
    bins = d.where("proposes").select("stratum", "good", rules.alias("r")).select("stratum", "good", "r.*")
    bins = bins.groupBy("stratum", "rule", "value").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))

    def propose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        found = proposal(*(pdf[c].to_numpy() for c in ("value", "good", "bad")), risk)
        stratum = key[0] if pd.notna(key[0]) else None
        return pd.DataFrame([(stratum, key[1], *found)] if found else [], columns=["stratum", "rule", "cutoff", "good", "bad"])

    rows = bins.groupBy("stratum", "rule").applyInPandas(propose, "stratum string, rule string, cutoff long, good long, bad long")
    # most telling first: the fewest good documents for each bad one
    order = F.struct((F.col("good") / F.col("bad")).alias("cost"), (-F.col("bad")).alias("bad"), "rule", "cutoff")
    plan = _io.keep(rows.groupBy("stratum").agg(F.array_sort(F.collect_list(order)).alias("plan")), "quality-plan")
    strata = max(1, plan.count())
    if strata <= SEND_ROWS:
        plan = F.broadcast(plan)
    value = F.create_map(*[x for r in RULES for x in (F.lit(r), F.col(r))])
    tests = d.where("good and not proposes").join(plan.withColumnRenamed("stratum", "_s"), F.col("stratum").eqNullSafe(F.col("_s")))
    first = F.array_position(F.transform("plan", lambda p: value[p["rule"]] > p["cutoff"]), True)
    tests = tests.select("stratum", "plan", first.alias("first")).groupBy("stratum").agg(F.first("plan").alias("plan"), F.count("*").alias("n"), *(F.sum((F.col("first") == k + 1).cast("long")).alias(f"n{k}") for k in range(len(RULES))))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held = [holding(int(r["n"]), [int(r[f"n{k}"]) for k in range(r["size"])], risk, delta / strata) for _, r in b.iterrows()]
            yield pd.DataFrame({"stratum": b["stratum"], "held": held})

    held = tests.select("stratum", F.size("plan").alias("size"), "n", *(f"n{k}" for k in range(len(RULES)))).mapInPandas(decide, "stratum string, held int")
    out = plan.withColumnRenamed("stratum", "_s").join(held, F.col("_s").eqNullSafe(F.col("stratum"))).where("held > 0")
    return out.select("stratum", F.map_from_entries(F.transform(F.slice("plan", F.lit(1), F.col("held")), lambda p: F.struct(p["rule"], p["cutoff"]))).alias("limits"))


def judge(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """docs' columns but the text, with COUNTS, base_failed, failed (the rules that reject it) and kept.

    docs: doc_id, text, the stratum and any other columns, of which those with the name of a result give way to it. A null stratum is one of
    its own; a stratum without enough good labelled documents has no certain cutoffs, so there only the base rules reject. Repeated rows each
    get their own result.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text" and not _io.named(c, RESULTS)))
    d = docs.select(F.col("doc_id").alias("id"), F.col(f"`{stratum}`").cast("string").alias("stratum"), F.xxhash64("text").alias("copy"), row.alias("row"), "text")
    counted = _io.keep(features(d), "quality-counts")
    limits = _io.keep(cutoffs(counted, labels, risk, delta), "quality-limits")
    if limits.count() <= SEND_ROWS:
        limits = F.broadcast(limits)
    d = counted.join(limits.withColumnRenamed("stratum", "_stratum"), F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    failed = F.array_compact(F.array(*[F.when(statistic(r) > F.col("limits")[r], F.lit(r)) for r in RULES]))
    d = d.withColumn("failed", F.when(F.col("limits").isNull(), F.array().cast("array<string>")).otherwise(failed))
    return d.select("row.*", *COUNTS, "base_failed", "failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    d = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed_rules"))
