"""Personal data: patterns for four kinds, and a linear-chain conditional random field over word shapes that adds what they miss.

The field is trained on a small labelled table, made by rule from a seed; its labels are none and the four kinds. Only tokens with a digit, an
@ or a spelled-out one can bear a kind, so the chain splits at all others, and Viterbi decodes the runs between, many at once.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
TABLE = 1 << 17  # places of tokens in a table of runs that are decoded together; a longer run has a table of its own

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: IP addresses and cards lie inside such runs.
_DIGITS = re.compile(r"[0-9][0-9. -]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """(start, end) of the patterns' matches, kind by kind, each leftmost and not overlapping; those that fail their check are dropped."""
    email: list[tuple[int, int]] = []
    done, k = 0, text.find("@")
    while k >= 0:
        a = k
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, k + 1) if a < k else None
        if m:
            email.append((a, m.end()))
            done = m.end()
        else:
            done = max(done, k + 1)
        k = text.find("@", done)
    ip, card = [], []
    for run in _DIGITS.finditer(text):
        at, s = run.start(), run.group()
        if s.count(".") >= 3:
            ip += [(at + m.start(), at + m.end()) for m in _IP.finditer(s) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m.group().split("."))]
        if len(s) >= 16:
            for m in _CARD.finditer(s):
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    card.append((at + m.start(), at + m.end()))
    phone = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15] if "+" in text else []
    return [email, ip, card, phone]


# --- the field ------------------------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^ \t-\r]+")
#: Runs of a token that its shape has in order.
PARTS = 12
_MAY = re.compile(r"[0-9@]|[(\[{](?:at|dot)[)\]}]", re.I | re.A)


def shape(token: str) -> str:
    """Runs of digits as 9 and their length, of letters as a or A; others as they are. The ends' punctuation counts too.

    After PARTS runs follows a digest of all the rest, in order, so that a long token's shape is short and of the whole token.
    """
    out = []
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|.", token, re.S):
        s = m.group()
        out.append(f"9{min(len(s), 20)}" if s[0] in "0123456789" else ("A" if s.isupper() else "a") if s[0].isalpha() else s)
    rest = "".join(out[PARTS:])
    return "".join(out[:PARTS]) + ("~" + hashlib.sha256(rest.encode("utf-8", "surrogatepass")).hexdigest()[:16] if rest else "")


def token_features(tokens: list[str], i: int) -> list[str]:
    """Of the i-th token, from its shape and its neighbours'."""
    t = tokens[i]
    s = shape(t.strip(".,;:!?\"'"))
    before = shape(tokens[i - 1].strip(".,;:!?\"'")) if i else "^"
    after = shape(tokens[i + 1].strip(".,;:!?\"'")) if i + 1 < len(tokens) else "$"
    digits = sum(map(str.isdigit, t))
    return ["any", f"s={s}", f"d={min(digits, 20)}", f"@={'@' in t}", f".={min(t.count('.'), 4)}", f"-={min(t.count('-'), 4)}", f"b={before}|{s}", f"a={s}|{after}", f"k={_kind_of_word(t)}"]


def _kind_of_word(t: str) -> str:
    low = t.lower().strip(".,;:")
    return "at" if low in ("(at)", "[at]", "{at}") else "dot" if low in ("(dot)", "[dot]", "{dot}") else "hex" if re.fullmatch(r"[\"']?[0-9a-f]{16,}[\"']?", low) and re.search("[a-f]", low) else "word" if low.isalpha() else "mixed"


def labelled_table(seed: int = 0, rows: int = 900) -> list[list[tuple[str, int]]]:
    """The training table: rows of (token, label), made by rule."""
    r = random.Random(seed)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 8)))
    word = lambda: name().capitalize() if r.random() < 0.2 else name()
    byte = lambda: str(r.randint(0, 255))
    host = lambda: r.choice(["example", name(), name() + n(1)]) + "." + r.choice(["com", "org", "net", "co.uk"])
    user = lambda: r.choice([name(), f"{name()}.{n(2)}", f"{name()}_{name()}", f"{name()}{n(2)}"])
    area = lambda: str(r.randint(2, 9)) + n(2)
    made = {
        1: [
            lambda: [f"{user()}@{host()}"],
            lambda: [user(), r.choice(["(at)", "[at]", "{at}"]), host()],
            lambda: [f"{user()}{r.choice(['(at)', '[at]'])}{host()}"],
            lambda: [user(), "[at]", name(), "[dot]", "com"],
        ],
        2: [lambda: [f"{byte()}.{byte()}.{byte()}.{byte()}"], lambda: [f"{byte()}.{byte()}.{byte()}.{byte()}:{n(4)}"]],
        3: [
            lambda: ["4" + n(15)],
            lambda: ["5" + n(3), n(4), n(4), n(4)],
            lambda: [f"4{n(3)}-{n(4)}-{n(4)}-{n(4)}"],
            lambda: ["37" + n(2), n(6), n(5)],
        ],
        4: [
            lambda: ["+1", f"({area()})", f"{n(3)}-{n(4)}"],
            lambda: [f"({area()})", f"{n(3)}-{n(4)}"],
            lambda: [f"{area()}-{n(3)}-{n(4)}"],
            lambda: [f"{area()}.{n(3)}.{n(4)}"],
            lambda: [f"+{r.randint(20, 99)}", n(2), n(4), n(4)],
            lambda: [f"+1-{area()}-{n(3)}-{n(4)}"],
        ],
        0: [
            lambda: [str(r.randint(1900, 2030))],
            lambda: [n(r.randint(1, 12))],
            lambda: [f"{n(4)}-{n(2)}-{n(2)}"],
            lambda: [f"{n(1)}.{n(1)}.{n(r.randint(1, 2))}"],
            lambda: [f"{n(2)}:{n(2)}"],
            lambda: [f"{n(1)},{n(3)}", "of", n(2)],
            lambda: [f"{n(2)}.{n(1)}%"],
            lambda: ["AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))],
            lambda: [name() + "=" + "".join(r.choice("0123456789abcdef") for _ in range(18))],
            lambda: ['"' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"'],
            lambda: ["".join(r.choice("0123456789abcdef") for _ in range(32))],
            lambda: [f"({n(1)})", n(1) + "."],
            lambda: [n(2), n(2), n(2)],
            lambda: [f"{n(2)}-{n(2)}"],
            lambda: [f"{n(1)}.{n(1)}.{n(1)}", f"v{n(1)}.{n(2)}"],
            lambda: ["@" + name()],
            lambda: [f"{n(5)}-{n(4)}"],
        ],
    }
    end = lambda x: x[:-1] + [x[-1] + r.choice(["", "", "", ".", ","])]
    out = []
    for _ in range(rows):
        row: list[tuple[str, int]] = [(word(), 0)]
        for _ in range(r.randint(1, 3)):
            k = r.choice([0, 0, 1, 2, 3, 4])
            row += [(t, k) for t in end(r.choice(made[k])())]
            if k == 0 or r.random() < 0.7:
                row += [(word(), 0) for _ in range(r.randint(1, 2))]
        out.append([*row, (word(), 0)])
    return out


class Field:
    """Weights of features by label, and of a label after another."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.names, self.weights, self.steps = names, weights, steps

    @classmethod
    def train(cls, table: list[list[tuple[str, int]]], rounds: int = 120, rate: float = 0.5, shrink: float = 1e-3) -> Field:
        """Maximum likelihood by forward-backward sums and Adagrad, all rows at once."""
        names: dict[str, int] = {}
        rows = [[[names.setdefault(f, len(names)) for f in token_features([t for t, _ in row], i)] for i in range(len(row))] for row in table]
        n, longest, k, width = len(rows), max(map(len, rows)), len(LABELS), len(rows[0][0])
        x = np.full((n, longest, width), len(names))
        y, live = np.zeros((n, longest), int), np.zeros((n, longest), bool)
        for i, row in enumerate(rows):
            x[i, : len(row)], y[i, : len(row)], live[i, : len(row)] = row, [label for _, label in table[i]], True
        w, t = np.zeros((len(names) + 1, k)), np.zeros((k, k))
        gw, gt = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
        pairs = live[:, 1:]
        for _ in range(rounds):
            e = w[x].sum(2)
            f, b = np.zeros((n, longest, k)), np.zeros((n, longest, k))
            f[:, 0] = e[:, 0]
            for j in range(1, longest):
                f[:, j] = np.where(live[:, j, None], _lse(f[:, j - 1, :, None] + t, 1) + e[:, j], f[:, j - 1])
            for j in range(longest - 2, -1, -1):
                b[:, j] = np.where(live[:, j + 1, None], _lse(t + (e[:, j + 1] + b[:, j + 1])[:, None, :], 2), 0)
            z = _lse(f[:, -1], 1)
            p = np.exp(f + b - z[:, None, None]) * live[:, :, None]
            two = np.exp(f[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs[:, :, None, None]
            dw, dt = -shrink * n * w, -shrink * n * t - two.sum((0, 1))
            gold = np.eye(k)[y] * live[:, :, None] - p
            np.add.at(dw, x.reshape(-1), np.repeat(gold.reshape(-1, k), width, 0))
            np.add.at(dt, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
            gw += dw * dw
            gt += dt * dt
            w += rate * dw / np.sqrt(gw)
            t += rate * dt / np.sqrt(gt)
            w[-1] = 0
        return cls(names, w, t)

    def decode(self, runs: list[tuple[list[str], list[bool]]]) -> list[list[int]]:
        """Viterbi over runs (tokens, whether each may bear a kind), whole, those of like length at once."""
        order = sorted(range(len(runs)), key=lambda i: -len(runs[i][0]))
        out: list[list[int]] = [[] for _ in runs]
        a = 0
        while a < len(order):
            z = a + max(1, TABLE // len(runs[order[a]][0]))
            for i, path in zip(order[a:z], self._decode([runs[i] for i in order[a:z]])):
                out[i] = path
            a = z
        return out

    def _decode(self, runs: list[tuple[list[str], list[bool]]]) -> list[list[int]]:
        """Viterbi over runs, the longest first, in one table."""
        longest, k = len(runs[0][0]), len(LABELS)
        unseen = len(self.names)
        e = np.full((len(runs), longest, k), 0.0)
        size = np.array([len(r[0]) for r in runs])
        for j, (tokens, may) in enumerate(runs):
            for p in range(len(tokens)):
                e[j, p] = self.weights[[self.names.get(f, unseen) for f in token_features(tokens, p)]].sum(0)
                if not may[p]:
                    e[j, p, 1:] = -1e9
        back = np.zeros((len(runs), longest, k), int)
        best = e[:, 0]
        final = best.copy()
        for p in range(1, longest):
            n = int((size > p).sum())
            s = final[:n, :, None] + self.steps
            back[:n, p] = s.argmax(1)
            final[:n] = s.max(1) + e[:n, p]
        out: list[list[int]] = [[] for _ in runs]
        for j in range(len(runs)):
            label = int(final[j].argmax())
            path = [label]
            for p in range(size[j] - 1, 0, -1):
                label = int(back[j, p, label])
                path.append(label)
            out[j] = path[::-1]
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


_fields: dict[int, Field] = {}


def field(seed: int = 0) -> Field:
    if seed not in _fields:
        _fields[seed] = Field.train(labelled_table(seed))
    return _fields[seed]


def _runs(text: str) -> list[tuple[list[str], list[bool], list[tuple[int, int]]]]:
    """Runs of tokens that may bear a kind, each with a token before and after for context."""
    tokens = [(m.group(), m.span()) for m in _TOKEN.finditer(text)]
    may = [bool(_MAY.search(t)) for t, _ in tokens]
    # what stands beside a spelled-out @ or dot may be part of an address
    spelled = [i for i, (t, _) in enumerate(tokens) if may[i] and _kind_of_word(t) in ("at", "dot")]
    for i in spelled:
        for j in (i - 1, i + 1):
            if 0 <= j < len(tokens):
                may[j] = True
    out, i = [], 0
    while i < len(tokens):
        if not may[i]:
            i += 1
            continue
        a = i
        while i < len(tokens) and may[i]:
            i += 1
        lo, hi = max(0, a - 1), min(len(tokens), i + 1)
        inside = [a <= p < i for p in range(lo, hi)]
        out.append(([tokens[p][0] for p in range(lo, hi)], inside, [tokens[p][1] for p in range(lo, hi)]))
    return out


def _added(text: str, run, labels: list[int]) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of the stretches of one label, without the punctuation at their ends, if they are whole."""
    _, inside, at = run
    p = 0
    while p < len(labels):
        k = labels[p]
        q = p + 1
        while q < len(labels) and labels[q] == k:
            q += 1
        if k and inside[p]:
            a, b = at[p][0], at[q - 1][1]
            while b > a and text[b - 1] in ".,;:!?\"'":
                b -= 1
            while a < b and text[a] in ".,;:!?\"'":
                a += 1
            s = text[a:b]
            digits = sum(map(str.isdigit, s))
            whole = (
                bool(re.search(r"(?i)[\w.%+-]\s*(?:@|[(\[{]at[)\]}])\s*[\w-]+(?:\.|\s*[(\[{]dot[)\]}]\s*)[a-z]", s)),
                bool(re.fullmatch(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]+)?", s)) and all(int(x) <= 255 for x in s.split(":")[0].split(".")),
                13 <= digits <= 19 and not re.search(r"[^0-9 -]", s) and luhn(re.sub(r"\D", "", s)),
                8 <= digits <= 15 and not re.search(r"[^0-9 ().+-]", s) and bool(re.search(r"[ ().-]", s)),
            )[k - 1]
            if whole:
                yield k - 1, a, b
        p = q


def _free(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether none of the spans, in order and apart from each other, overlaps a to b."""
    k = bisect_right(spans, a, key=lambda s: s[1])
    return k == len(spans) or spans[k][0] >= b


def find(texts: list[str], model: Field) -> list[tuple[list[list[tuple[int, int]]], list[tuple[int, int, int]]]]:
    """For each text the patterns' spans by kind, and (kind, start, end) of those that the field adds: what overlaps none of the patterns'."""
    based = [base_spans(t) for t in texts]
    runs = [_runs(t) for t in texts]
    flat = [(i, r) for i, rs in enumerate(runs) for r in rs]
    labels = model.decode([(r[0], r[1]) for _, r in flat])
    more: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (i, run), path in zip(flat, labels):
        if any(path):
            for k, a, b in _added(texts[i], run, path):
                if all(_free(spans, a, b) for spans in based[i]) and (not more[i] or more[i][-1][2] <= a):  # runs come in order
                    more[i].append((k, a, b))
    return list(zip(based, more))


_HAS = np.zeros(256, bool)
_HAS[list(b"0123456789@[({")] = True


def _scan(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            for i, j, raw, offsets in _io.slices(b.column(k)):
                sums = np.concatenate(([0], np.cumsum(_HAS[raw])))
                some = np.flatnonzero(sums[offsets[1:]] > sums[offsets[:-1]])
                data = raw.tobytes()
                found = find([data[offsets[r] : offsets[r + 1]].decode() for r in some.tolist()], model)
                n, base, spans = np.zeros((len(KINDS), j - i), np.int64), [""] * (j - i), [""] * (j - i)
                for r, (own, more) in zip(some.tolist(), found):
                    flat = [(kind, a, z) for kind, s in enumerate(own) for a, z in s]
                    n[:, r] = [len(s) for s in own]
                    base[r] = ",".join(f"{KINDS[x]}:{a}:{z}" for x, a, z in sorted(flat))
                    spans[r] = ",".join(f"{KINDS[x]}:{a}:{z}" for x, a, z in sorted(flat + more))
                sums256 = [hashlib.sha256(x.encode()).hexdigest() for x in base]
                yield pa.RecordBatch.from_arrays([*(b.column(c)[i:j] for c in range(k)), *map(pa.array, n), pa.array(sums256), pa.array(spans)], [*map(str, range(k)), *map(str, range(100, 106))])

    return run


def scan(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """docs' columns but the text, with n_<kind> and base_sha256 of the patterns' spans, and spans, all as kind:start:end.

    Starts and ends are code points. Null texts count as empty, and have no spans; repeated rows each get their own result.
    Columns with the name of a result give way to it.
    """
    spark = docs.sparkSession
    _io.ready(spark)
    sent = spark.sparkContext.broadcast(model or field())
    results = (*(f"n_{k}" for k in KINDS), "base_sha256", "spans")
    d = _io.pack(docs, ["text"], results).select("_others", "text")
    schema = _io.schema(d, ["_others"], ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
    out = d.mapInArrow(_scan(sent, 1), schema)
    return out.select(*_io.unpack(out, docs.columns, [], ("text", *results)), *results)


def redacted(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; spans that overlap go as one, by the first one's kind."""
    d = scan(_io.pack(docs, ["text"]).withColumn("_text", F.col("text")), model)
    part = F.transform(F.filter(F.split("spans", ","), lambda s: s != ""), lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("a"), F.split(s, ":")[2].cast("int").alias("z"), F.split(s, ":")[0].alias("k")))
    text = F.col("_text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, s: F.when(s["a"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["z"]).alias("at"))).otherwise(F.struct(F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["a"] - acc["at"]), F.lit("["), s["k"], F.lit("]")).alias("out"), s["z"].alias("at")))
    done = F.aggregate(F.array_sort(part), start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    return d.withColumn("text", done).select(*_io.unpack(docs, docs.columns, ["text"]))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
