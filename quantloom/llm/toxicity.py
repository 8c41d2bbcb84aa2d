"""Toxicity after noisy-channel deobfuscation.

Tokens that may be disguised (letters swapped for digits or signs, letters doubled at will, words spelled out with gaps) are decoded: a
lattice holds the letters that each character may stand for, and Viterbi finds the likeliest reading under a channel model and a character
trigram model; a run of spelled-out letters may hold several words, so there the lattice ends words too. Tokens and runs are decoded whole,
whatever their length. The trigrams are counted over all documents. The restored words are then scored with the others: a document's score combines
(noisy-or) the precision of the word beginnings found in it that mark toxic documents, learned from labelled ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io, _text

FIT_DOCS = 12_000  # labelled documents that the marks are learned from, about
FOLDS, HELD = 5, 0
BEGINNINGS = (4, 5, 6, 8)  # bytes
LEAST_DOCS = 6
LEAST_PRECISION = 0.97
SPELLED = 3  # single letters in a row, at least, that may spell words
REACH = 12

# --- characters -----------------------------------------------------------------------------------------------------------------------

SYMBOLS = 64  # 0 ends a word, 1-26 are a-z, 27-58 the letters U+00C0-U+00FF without their case, 63 is any other letter
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[0x61:0x7B] = np.arange(1, 27)
_SYMBOL[0x41:0x5B] = np.arange(1, 27)
_SYMBOL[0x80:0xC0] = (np.arange(0x80, 0xC0) & 0x1F) + 27
_SYMBOL[0xC0:] = 63
_SYMBOL[0xC3] = -1  # the lead of U+00C0-U+00FF; its second byte is the symbol

#: What a disguising character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou", "#": "h",
}
GAPS = " .-_*~'·"
_SWAP, _REPEAT, _GAP, _KEEP = np.log(0.3), np.log(0.2), np.log(0.5), np.log(0.9)


def trigram_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of symbol trigrams, as a flat array of SYMBOLS ** 3; rows are apart."""
    s = _SYMBOL[raw]
    two = np.flatnonzero((raw >= 0x80) & (raw < 0xC0))
    s[two[raw[two - 1] != 0xC3]] = -1  # other letters count once, at their lead
    ends = np.zeros(len(raw) + 1, bool)
    ends[offsets] = True
    s = np.insert(s, np.flatnonzero(ends), 0)
    s = s[s >= 0]
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
    s = np.concatenate(([0], s, [0]))
    return np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for b in batches:
        for _, _, raw, offsets in _io.slices(b.column(0)):
            total += trigram_counts(raw, offsets)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])


class CharModel:
    """Log-probabilities of a symbol after two others, interpolated with shorter contexts."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        c3 = np.zeros(SYMBOLS**3)
        c3[grams] = n
        c3 = c3.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 0.1) / (c1.sum() + 0.1 * SYMBOLS)
        p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
        self.logp = np.log((c3 + 5 * p2) / (c3.sum(2, keepdims=True) + 5)).astype(np.float32)


def char_model(docs: DataFrame) -> CharModel:
    """From all texts of docs; at most SYMBOLS ** 3 counts come to the driver."""
    rows = docs.select("text").mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    return CharModel(rows.gram.to_numpy(), rows.n.to_numpy())


def _code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else (ord(c) & 0x1F) + 27 if "À" <= c <= "ÿ" else 63


def _readings(c: str, before: str) -> list[tuple[str, float]]:
    """What a character may stand for, '' for nothing, with log-probabilities."""
    out = []
    if c.isalpha():
        out.append((c, _KEEP))
        if c == before:
            out.append(("", _REPEAT))
    for x in LEET.get(c, ""):
        out.append((x, _SWAP))
    if before and c == before and not c.isalpha():
        out.append(("", _REPEAT))
    if c in GAPS:
        out.append(("", _GAP))
    return out


def decode(token: str, model: CharModel, spaced: bool = False) -> str:
    """The likeliest word that a token (lower case, characters of LEET, GAPS and letters only) stands for, by Viterbi over its lattice; with
    `spaced` the likeliest words, joined by spaces, as a word may end after any letter."""
    logp = model.logp
    # state: the last two symbols; with its score, the reading so far as linked (before, letter)
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    before = ""
    for c in token:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for x, cost in _readings(c, before):
            for (a, b), (p, word) in best.items():
                if x:
                    k = _code(x)
                    state, q, w = (b, k), p + cost + float(logp[a, b, k]), (word, x)
                else:
                    state, q, w = (a, b), p + cost - 1.0, word
                if state not in after or after[state][0] < q:
                    after[state] = (q, w)
        if after:
            best = after
            if spaced:
                for (a, b), (p, word) in list(best.items()):
                    q = p + float(logp[a, b, 0])
                    if b and ((b, 0) not in best or best[b, 0][0] < q):
                        best[b, 0] = q, (word, " ")
        before = c
    node = max(((p + (float(logp[a, b, 0]) if b else 0.0), i, w) for i, ((a, b), (p, w)) in enumerate(best.items())))[2]
    letters = []
    while node is not None:
        node, x = node
        letters.append(x)
    return "".join(reversed(letters)).strip()


_PIECE = re.compile(r"(?:[^\W\d_]|[%s])+" % re.escape("".join(LEET) + "._-~'·"))


_LONG = re.compile(r"([^\W\d_])\1{2,}")
_DOUBLE = re.compile(r"([^\W\d_])\1+")


def restore(token: str, model: CharModel, spaced: bool = False) -> list[str]:
    """The words that a disguised token may stand for; its own letters are no part of it. spaced: it is spelled-out letters, joined; the
    likeliest words then, and in case they are cut elsewhere what begins at each letter, of the run and its likeliest reading, REACH letters of
    it."""
    out = []
    for piece in _PIECE.findall(token.lower()):
        piece = piece.strip(GAPS).rstrip("!|#*+(")
        if any(c.isalpha() for c in piece) or sum(c in LEET for c in piece) > 2:
            read = [decode(x, model) for x in _variants(piece)]
            out += read
            if spaced:
                out += decode(piece, model, spaced=True).split()
                out += [x[i : i + REACH] for x in dict.fromkeys((piece, read[0])) for i in range(1, len(x) - min(BEGINNINGS) + 1)]
    return list(dict.fromkeys(out))


def _variants(part: str) -> list[str]:
    """The piece; with long runs of a letter cut to one and to two; with all doubled letters single, if there are three or more; with each
    vowel for a lone star."""
    out = [part]
    if _LONG.search(part):
        out += [_LONG.sub(r"\1", part), _LONG.sub(r"\1\1", part)]
    if len(_DOUBLE.findall(part)) >= 3:
        out.append(_DOUBLE.sub(r"\1", part))
    if part.count("*") == 1:
        out += [part.replace("*", v) for v in "aeiou"]
    return list(dict.fromkeys(out))


# --- tokens that may be disguised -----------------------------------------------------------------------------------------------------

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
_LETTER[0x41:0x5B] = True
_LETTER[0x80:] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in [*LEET, *GAPS] if ord(c) < 128 and c not in " '"]] = True
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[0x61:0x7B] = False
_NOT_LETTER[0x80:] = False


def suspects(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) bytes of what may be disguised: tokens with a sign before a letter, three equal letters or three
    doubled ones, and SPELLED or more tokens of one letter in a row, taken together."""
    starts, ends, first = _text.words(raw, offsets)
    if not len(starts):
        e = np.zeros(0, np.int64)
        return e, e, e
    row = _text.row_of(first)
    letter, sign = _LETTER[raw], _SIGN[raw]
    mark = np.zeros(len(raw), bool)
    mark[:-1] = sign[:-1] & letter[1:]
    ascii_letter = letter & (raw < 0x80)
    low = _text.LOWER[raw]
    if len(raw) > 2:
        mark[2:] |= ascii_letter[2:] & (low[2:] == low[1:-1]) & (low[2:] == low[:-2])
        # a sign or digit between a letter and the token's end: "scum" as "5cum" is met above, "idio7" here
        digit = (raw >= 0x30) & (raw < 0x3A) | (raw == 0x24) | (raw == 0x40)
        mark[1:] |= digit[1:] & letter[:-1]
    sums = np.concatenate(([0], np.cumsum(mark)))
    odd = sums[ends] > sums[starts]
    if len(raw) > 2:
        pair = np.zeros(len(raw), bool)
        pair[1:] = ascii_letter[1:] & (low[1:] == low[:-1])
        pair[1:] &= ~pair[:-1]
        sums = np.concatenate(([0], np.cumsum(pair)))
        odd |= sums[ends] - sums[np.minimum(starts + 1, ends)] >= 3
    size = ends - starts
    point = np.zeros(256, bool)
    point[list(b".-_,")] = True
    short = (ascii_letter | sign)[starts] & ((size == 1) | (size == 2) & point[raw[ends - 1]])
    new = np.ones(len(starts), bool)
    new[1:] = ~(short[1:] & short[:-1] & (row[1:] == row[:-1]))
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(starts)))
    run = short[begin] & (size >= SPELLED)
    at, last = begin[run], (begin + size - 1)[run]
    return np.concatenate((row[odd], row[at])), np.concatenate((starts[odd], starts[at])), np.concatenate((ends[odd], ends[last]))


def _marks(raw: np.ndarray, offsets: np.ndarray, model: CharModel, cache: dict[bytes, list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, mark, hash of the word before) of each word and beginning of a word, restored words included."""
    low = _text.LOWER[raw]
    rows, found, before = _word_marks(low, offsets)
    row, start, end = suspects(raw, offsets)
    if len(row):
        more: list[list[str]] = []
        data = raw.tobytes()
        for a, z in zip(start.tolist(), end.tolist()):
            token = data[a:z]
            if token not in cache:
                if len(cache) > 100_000:
                    cache.clear()
                spelled = token.decode().split()
                text = "".join(x[0] if len(spelled) > 1 else x for x in spelled)
                cache[token] = restore(text, model, len(spelled) > 1)
            more.append(cache[token])
        words = "\n".join(" ".join(x) for x in more).encode()
        extra = np.frombuffer(words, np.uint8)
        lines = np.concatenate(([0], np.flatnonzero(extra == 0x0A) + 1, [len(extra)]))
        r, f, _ = _word_marks(extra, lines)
        near = _text.hashes(low, np.maximum(0, start - 8), start)
        rows, found, before = np.concatenate((rows, row[r])), np.concatenate((found, f)), np.concatenate((before, near[r]))
    return rows, found, before


def _word_marks(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = _text.words(low, offsets, _NOT_LETTER)
    row = _text.row_of(first)
    h = _text.hashes(low, starts, ends)
    before = np.concatenate((h[:1], h[:-1]))
    rows, marks, near = [row], [h], [before]
    for k in BEGINNINGS:
        long = np.flatnonzero(ends - starts > k)
        rows.append(row[long])
        marks.append(_text.mix(_text.hashes(low, starts[long], starts[long] + k) ^ np.uint64(k)))
        near.append(before[long])
    return np.concatenate(rows), np.concatenate(marks), np.concatenate(near)


# --- learning and scoring -------------------------------------------------------------------------------------------------------------


def _sorted_in(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    i = np.searchsorted(table, x)
    i[i == len(table)] = 0
    return i, table[i] == x


def _seen(sent, wanted):
    """(text, toxic) -> distinct (mark, toxic, place, doc) of a batch; place: a hash of the word before; doc: one of the text"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, list[str]] = {}
        for b in batches:
            toxic = np.asarray(b.column(1))
            for i, j, raw, offsets in _io.slices(b.column(0)):
                texts = _text.mix(_text.hashes(raw, offsets[:-1], offsets[1:]) if len(raw) else np.zeros(j - i, np.uint64))
                rows, marks, place = _marks(raw, offsets, sent.value, cache)
                if wanted is not None:
                    ok = _sorted_in(wanted.value, marks)[1]
                    rows, marks, place = rows[ok], marks[ok], place[ok]
                order = np.lexsort((place, marks, rows))
                rows, marks, place = rows[order], marks[order], place[order]
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:] != rows[:-1]) | (marks[1:] != marks[:-1]) | (place[1:] != place[:-1])
                rows, marks, place = rows[new], marks[new], place[new]
                cols = [marks.view(np.int64), toxic[rows + i].astype(np.int32), place.view(np.int64), texts[rows].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["mark", "toxic", "place", "doc"])

    return run


class Marks:
    """Hashes of word beginnings, ascending, with the chance that a document that has one is toxic; `other`: that of a document without any."""

    def __init__(self, marks: np.ndarray, chance: np.ndarray, other: float):
        order = np.argsort(marks)
        self.marks, self.chance, self.other = marks[order], chance[order], other


def learn(docs: DataFrame, labels: DataFrame, model: CharModel, fit_docs: int = FIT_DOCS) -> Marks:
    """From about fit_docs labelled documents. A mark has high precision, and stands in toxic documents after so many different words that chance
    doesn't explain it; copies of a document have the same words before, and so count once."""
    spark = docs.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    near = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, fit_docs / max(1, n))))
    some = docs.select("doc_id", "text").join(F.broadcast(near) if n <= 50 * fit_docs else near, "doc_id")
    some = _io.keep(some.select("text", F.col("toxic").cast("int").alias("toxic")), "toxic-sample")
    sizes = {r.toxic: r.n for r in some.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    base = (n1 + 0.5) / (n1 + n0 + 1)
    sent = spark.sparkContext.broadcast(model)
    schema = "mark long, toxic int, place long, doc long"
    # a mark that has nothing to do with toxicity comes only with toxic documents so often: far under one such mark is expected
    least = max(LEAST_DOCS, int(np.ceil(np.log(1e-9) / np.log(max(base, 1e-9)))))
    n = F.least(F.countDistinct("place"), F.countDistinct("doc")).alias("n")
    often = some.where("toxic = 1").mapInArrow(_seen(sent, None), schema).groupBy("mark").agg(n).where(F.col("n") >= least).toPandas()
    marks = np.sort(often["mark"].to_numpy(np.int64).view(np.uint64))
    at = lambda df: np.searchsorted(marks, df["mark"].to_numpy(np.int64).view(np.uint64))
    wanted = spark.sparkContext.broadcast(marks)
    against = some.where("toxic = 0").mapInArrow(_seen(sent, wanted), schema).groupBy("mark").agg(F.countDistinct("doc").alias("n")).toPandas()
    count = np.zeros((len(marks), 2))
    count[at(often), 1] = often["n"]
    count[at(against), 0] = against["n"]
    good = np.flatnonzero(count[:, 1] >= LEAST_PRECISION * count.sum(1))
    marks, count = marks[good], count[good]
    chance = (count[:, 1] + 1) / (count.sum(1) + 1.1)
    return Marks(marks, np.minimum(chance, 0.999), min(base, 0.05))


def _score(sent, learned, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, list[str]] = {}
        t = learned.value
        for b in batches:
            for i, j, raw, offsets in _io.slices(b.column(k)):
                rows, marks, _ = _marks(raw, offsets, sent.value, cache)
                at, ok = _sorted_in(t.marks, marks)
                pairs = np.unique(rows[ok] * (len(t.marks) + 1) + at[ok])
                no = np.full(j - i, np.log1p(-t.other))
                np.add.at(no, pairs // (len(t.marks) + 1), np.log1p(-t.chance[pairs % (len(t.marks) + 1)]) if len(pairs) else 0.0)
                yield pa.RecordBatch.from_arrays([*(b.column(c)[i:j] for c in range(k)), pa.array(-np.expm1(no))], [*map(str, range(k)), "_score"])

    return run


def score(docs: DataFrame, model: CharModel, marks: Marks) -> DataFrame:
    """docs' columns with _score, 0 to 1. Null and empty texts have the score of a document without marks; the text stays. Other columns of
    whatever name stay, but one named _score gives way."""
    spark = docs.sparkSession
    _io.ready(spark)
    sent, learned = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(marks)
    packed = _io.pack(docs, ["text"], ("_score",))
    keys = packed.columns
    out = packed.withColumn("_scored", F.col("text")).mapInArrow(_score(sent, learned, len(keys)), _io.schema(packed, keys, "_score double"))
    return out.select(*_io.unpack(out, docs.columns, ["text"], ("_score",)), "_score")


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[CharModel, Marks]:
    """The character model of all docs, and the marks of labelled ones that aren't held out."""
    _io.ready(docs.sparkSession)
    model = char_model(docs)
    return model, learn(docs, labels.where(~held_out()), model)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those of score 0.5 and more."""
    return score(_io.pack(docs, ["text"]), *fitted(docs, labels)).where("_score < 0.5").select(*_io.unpack(docs, docs.columns, ["text"]))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model, marks = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    d = score(docs, model, marks)
    return d.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
