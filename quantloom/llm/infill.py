"""Fill-in-the-middle: a text is cut into prefix, middle and suffix at bounds of its units, and written with the middle last.

Each text is decoded to code points; where the class of one differs from that of the next a unit ends, and ranks drawn from the document's id choose two of
those bounds. Texts are taken one by one, whole; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Percent of texts that are transformed, and of those that begin with the suffix.
RATE, SPM_RATE = 100, 50
SEED = 7
RESULTS = ("_n", "_form", "_prefix_chars", "_middle_chars", "_out")
_SPACES = np.array([0x20, *range(0x09, 0x0E)], np.uint32)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def classes(cp: np.ndarray, unit: str) -> np.ndarray:
    """A number for each code point; a unit is a run of equal ones. line: up to and with a newline; word: white space or not; char: each its own."""
    if unit == "line":
        ends = cp == 10
        return np.cumsum(ends) - ends
    if unit == "word":
        return np.isin(cp, _SPACES)
    if unit == "char":
        return np.arange(len(cp))
    raise ValueError(f"unit {unit!r}: line, word or char")


def bounds(cp: np.ndarray, unit: str) -> np.ndarray:
    """0, the end of each unit, in code points."""
    if not len(cp):
        return np.zeros(1, np.int64)
    c = classes(cp, unit)
    return np.concatenate(([0], np.flatnonzero(c[1:] != c[:-1]) + 1, [len(cp)]))


def draws(seed: int, doc_id: int | None) -> tuple[int, ...]:
    """Four numbers of 32 bits for a document; a null id is a name of its own."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * k : 8 * k + 8], 16) for k in range(4))


def transform(text: str, h: tuple[int, ...], unit: str = "line", rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple:
    """(units, form, code points of the prefix, of the middle, output) of one text. Empty texts, and ones that contain a mark, stay plain."""
    cp = points(text)
    at = bounds(cp, unit)
    n = len(at) - 1
    if not n or h[2] % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = (p.tobytes().decode("utf-32-le", "surrogatepass") for p in (cp[: at[a]], cp[at[a] : at[b]], cp[at[b] :]))
    p, s, m = MARKS
    if h[3] % 100 < spm_rate:
        return n, "spm", int(at[a]), int(at[b] - at[a]), s + suffix + p + prefix + m + middle
    return n, "psm", int(at[a]), int(at[b] - at[a]), p + prefix + s + suffix + m + middle


def restore(out: str, form: str) -> str:
    """The text that an output was made from. Texts with marks are plain, so each mark stands once."""
    if form == "plain":
        return out
    p, s, m = MARKS
    first, second = (p, s) if form == "psm" else (s, p)
    head, middle = out[len(first) :].split(m)
    one, two = head.split(second)
    return one + middle + two if form == "psm" else two + middle + one


def _rows(seed: int, unit: str, rate: int, spm_rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, size, first = [], 0, 0
            for i, (doc_id, raw) in enumerate(zip(b.column(1), b.column(2))):
                # bytes that aren't UTF-8 are carried along as they are
                text = (raw.as_py() or b"").decode("utf-8", "surrogateescape")
                n, form, prefix, middle, out = transform(text, draws(seed, doc_id.as_py()), unit, rate, spm_rate)
                made.append((n, form, prefix, middle, out.encode("utf-8", "surrogateescape")))
                size += len(made[-1][-1])
                if size > 1 << 24 or i == b.num_rows - 1:
                    yield _batch(b.slice(first, i + 1 - first), made)
                    made, size, first = [], 0, i + 1

    return run


def _batch(b: pa.RecordBatch, made: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(zip(*made), types))], ["_others", "doc_id", *RESULTS])


def infill(docs: DataFrame, *, unit: str = "line", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """docs' columns but the text, with _n (units), _form (plain, psm or spm), _prefix_chars and _middle_chars (code points; null if plain) and _out.

    docs: doc_id, text and any other columns, which stay but for ones with a result's name. Null texts count as empty, which are plain, as are texts that
    contain a mark. Equal ids are cut at equal ranks; repeated rows each get their result; an empty table gives an empty one. A text is held whole in memory,
    at four bytes a code point, and no two at once.
    """
    _io.ready(docs.sparkSession)
    d = _io.pack(docs, ["doc_id", "text"], RESULTS).select("_others", F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    schema = _io.schema(d, ["_others", "doc_id"], "_n long, _form string, _prefix_chars long, _middle_chars long, _out binary")
    out = d.mapInArrow(_rows(seed, unit, rate, spm_rate), schema).withColumn("_out", F.col("_out").cast("string"))
    return out.select(*_io.unpack(out, docs.columns, ["doc_id"], ("text", *RESULTS)), *RESULTS)


def restored(rows: DataFrame) -> DataFrame:
    """rows with _text, the text rebuilt from _out and _form alone."""
    p, s, m = MARKS
    # one split a mark, by column functions: each mark stands once
    between = lambda a, b: F.substring("_out", F.locate(a, F.col("_out")) + len(a), F.locate(b, F.col("_out")) - F.locate(a, F.col("_out")) - len(a))
    end = F.substring("_out", F.locate(m, F.col("_out")) + len(m), F.length("_out"))
    text = F.when(F.col("_form") == "psm", F.concat(between(p, s), end, between(s, m))).when(F.col("_form") == "spm", F.concat(between(p, m), end, between(s, p))).otherwise(F.col("_out"))
    return rows.withColumn("_text", text)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = restored(infill(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return d.select(
        "doc_id", F.col("_n").alias("n"), F.col("_form").alias("form"), F.col("_prefix_chars").alias("prefix_chars"), F.col("_middle_chars").alias("middle_chars"),
        F.sha2("_out", 256).alias("output_sha256"), F.sha2("_text", 256).alias("restored_sha256"),
    )
