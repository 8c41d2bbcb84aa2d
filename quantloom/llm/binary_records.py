"""Token ids as length-delimited binary records, with an offset index beside each file for shuffled reads.

A record: its payload's length (8 bytes), the masked CRC-32 of these 8 bytes (4), the payload, the masked CRC-32 of the payload (4). A
payload: flags (1 byte: 1, the id is null; 2, ids are 4 bytes wide), doc_id (8), then the ids, 2 or 4 bytes each. All little-endian. An
index file has the offset and payload length of each record, 8 bytes each. Files part-NNNNN.rec hold ascending doc_ids, file after file.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import compress
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _io

END = 0  # the id that ends a document
FILE_BYTES = 32 << 20  # of text in a file, about
CACHED = 800_000  # words whose ids a worker keeps

_MASK = 0xA282EAD8
#: Where a text can't be cut before each space: one that white space or the end follows.
_LOOSE = re.compile(r" (?:\s|\Z)")
_TIGHT = re.compile(r"(?= \S)")


def masked_crc(data: bytes) -> int:
    """CRC-32 rotated right by 15 bits, plus a constant, so that a checksum of data with checksums in it stays sound."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


def payload(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    return struct.pack("<Bq", (doc_id is None) | wide << 1, doc_id or 0) + ids


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from("<Bq", data)
    return None if flags & 1 else doc_id, np.frombuffer(data, "<u4" if flags & 2 else "<u2", offset=9).astype("<u4")


def records(file) -> Iterator[bytes]:
    """The payloads of an open file, one after the other; ValueError where a checksum or a length is wrong."""
    while head := file.read(12):
        if len(head) < 12 or masked_crc(head[:8]) != struct.unpack_from("<I", head, 8)[0]:
            raise ValueError("a record's length is damaged")
        n = struct.unpack_from("<Q", head)[0]
        data = file.read(n + 4)
        if len(data) < n + 4 or masked_crc(data[:n]) != struct.unpack_from("<I", data, n)[0]:
            raise ValueError("a record's payload is damaged")
        yield data[:n]


def record(file, index: bytes, i: int) -> bytes:
    """The i-th record of a seekable file, by its index."""
    offset, n = struct.unpack_from("<QQ", index, 16 * i)
    file.seek(offset)
    data = file.read(n + 16)
    found = next(records(pa.BufferReader(data)), None)
    if found is None or len(found) != n:
        raise ValueError("index and records differ")
    return found


def cuts_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer's description is of a byte-level one that takes a text's pieces between spaces each by itself, as they are."""
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    return plain and not spec.get("normalizer") and not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in spec.get("added_tokens") or ())


class Encoder:
    """A tokenizer of the tokenizers library with the ids of words kept. A pre-tokenizer of the byte-level kind, with the usual pattern, never joins
    what stands before a space and what follows it, unless that is white space too; so texts are encoded in pieces cut there. With any other kind whole texts
    are encoded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = cuts_at_spaces(json.loads(self.tokenizer.to_str()))
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # the library's own store of words: those that come here are new to it
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = "<u4" if self.wide else "<u2"
        self.words: dict[str, bytes] = {}

        # tokens that begin with a space
        self.opens = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """(word, the ids of " " + word), for words without spaces: many go as one text, in which each begins at a token that begins with one."""
        parts = [words[k : k + 400] for k in range(0, len(words), 400)]
        for part, ids in zip(parts, self._ids([" " + " ".join(p) for p in parts])):
            data, width = ids.tobytes(), ids.itemsize
            at = (np.append(np.flatnonzero(self.opens[ids]), len(ids)) * width).tolist()
            yield from zip(part, map(data.__getitem__, map(slice, at, at[1:])))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return [ids.tobytes() for ids in self._ids(texts)]
        if len(self.words) > CACHED:
            self.words = {}
        cut = []
        odd: set[str] = set()
        for t in texts:
            if _LOOSE.search(t):
                head, *rest = _TIGHT.split(t)
                rest = [x[1:] for x in rest]
                cut.append((head, rest))
                odd.update(w for w in rest if " " in w)
            else:
                head, *rest = t.split(" ")
                cut.append((head, rest))
        heads = self._ids([head for head, _ in cut])
        found = [list(map(self.words.get, rest)) for _, rest in cut]
        missing: set[str] = set()
        for (_, rest), x in zip(cut, found):
            missing.update(compress(rest, map(partial(is_, None), x)))
        ids = self.words
        if odd:
            missing -= odd
            odd = list(odd - ids.keys())
            ids.update(zip(odd, (x.tobytes() for x in self._ids([" " + w for w in odd]))))
        ids.update(self._spaced(list(missing)))
        return [h.tobytes() + b"".join([v or ids[w] for v, w in zip(x, rest)] if None in x else x) for h, (_, rest), x in zip(heads, cut, found)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _write(folder: str, tokenizer: str, end: int, sub: int = 200):
    """Rows (doc_id, text) of a partition, in order -> its files, and a row on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        part = task.partitionId()
        files, at = fs.FileSystem.from_uri(folder)
        enc = encoder(tokenizer)
        last = np.array([end], enc.kind).tobytes()
        name, mine = f"{at}/part-{part:05d}", f"{at}/.part-{part:05d}-{task.taskAttemptId()}"
        docs = ids = offset = 0
        with files.open_output_stream(f"{mine}.rec") as out, files.open_output_stream(f"{mine}.idx") as idx:
            for b in batches:
                for i in range(0, len(b), sub):
                    piece = b.slice(i, sub)
                    texts = piece.column(1).fill_null("").to_pylist()
                    done, places = [], []
                    for doc_id, x in zip(piece.column(0).to_pylist(), enc.encode(texts)):
                        done.append(frame(payload(doc_id, x + last, enc.wide)))
                        places.append((offset, len(done[-1]) - 16))
                        offset += len(done[-1])
                        docs += 1
                        ids += (len(x) + len(last)) // (4 if enc.wide else 2)
                    out.write(b"".join(done))
                    idx.write(np.array(places, "<u8").tobytes())
        if docs:  # whole files take their names at once; a second attempt's are the same
            files.move(f"{mine}.idx", f"{name}.idx")
            files.move(f"{mine}.rec", f"{name}.rec")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": pa.array([docs], pa.int64()), "ids": pa.array([ids], pa.int64())})
        else:
            files.delete_file(f"{mine}.idx")
            files.delete_file(f"{mine}.rec")

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, *, end: int = END, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write docs (doc_id, text) to `folder`, which executors share, in ascending doc_id order (null first); returns (part, docs, ids, ids_before)
    of its files, kept as a table.

    Null and empty texts are the end id alone. Rows of one doc_id stand next to each other, in order of a hash of their texts. An empty table
    writes no file. `end` is appended to each document.
    """
    spark = docs.sparkSession
    _io.ready(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = d.repartitionByRange(max(1, -(-total // file_bytes)), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    parts = _io.keep(dealt.mapInArrow(_write(folder, tokenizer, end), "part int, docs long, ids long"), "parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return _io.keep(parts.withColumn("ids_before", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long")), "parts")


def _read(folder: str, each: Callable[[int | None, np.ndarray, int], tuple], names: list[str], kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(folder)
        for b in batches:
            for part, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                with files.open_input_stream(f"{at}/part-{part:05d}.rec", buffer_size=1 << 20) as file:
                    for data in records(file):
                        doc_id, ids = parse(data)
                        rows.append(each(doc_id, ids, start))
                        start += len(ids)
                        if len(rows) == 1000:
                            yield _batch(rows, names, kinds)
                            rows = []
                if rows:
                    yield _batch(rows, names, kinds)

    return run


def _batch(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _dealt(parts: DataFrame) -> DataFrame:
    n = max(1, parts.count())
    return parts.select("part", "ids_before").repartition(n, "part")


def read(parts: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, ids) of the files that write() described; start counts the ids of all documents before."""
    run = _read(folder, lambda doc_id, ids, start: (doc_id, start, ids), ["doc_id", "start", "ids"], [pa.int64(), pa.int64(), pa.list_(pa.int64())])
    return _dealt(parts).mapInArrow(run, "doc_id long, start long, ids array<long>")


def digests(parts: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the files, the checksum over the ids as 4 bytes each."""
    run = _read(folder, lambda doc_id, ids, start: (doc_id, start, len(ids), zlib.crc32(ids.tobytes())), ["doc_id", "start", "n_tokens", "ids_crc32"], [pa.int64()] * 4)
    return _dealt(parts).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = _io.fresh_path(spark, "records")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(write(docs, folder, public_tokenizers.path("byte_bpe_50k.json")), folder)
