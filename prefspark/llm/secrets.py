"""Operator 6, secret scans with a randomness test battery.

Three base patterns (kinds ``assign``, ``access``, ``hex``) always count. Beside
them, every run of at least ``MIN_RUN`` characters of ``[A-Za-z0-9+/_-]`` (with
its padding) that mixes letters and digits is a candidate. Its encoding is
inferred (hex, base32 or base64), and tests ask whether it could be uniform draws of that alphabet:

- chi-squared against equal counts of all symbols of the alphabet, and of its
  groups (capitals, small letters, digits, marks), whose counts are larger;
- runs above and below the middle of the alphabet;
- serial correlation of neighbouring symbol values.

The smallest of the four p-values, times four, is the candidate's p-value for
"random". False-discovery control is aware of length: candidates fall into
strata by encoding and length band, the p-values of all documents are counted
per stratum, and in each the Benjamini-Hochberg step at level ``FDR`` marks what
is not random. What it leaves is reported with kind ``random``.

Spans are code points, end exclusive. Defined results: null and empty texts have
no spans; repeated rows are answered row by row; an empty table gives no rows;
texts of any length are scanned whole. ``scan`` ignores other columns, ``redact``
carries them unchanged.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.llm.common import code_points, prepare, table, utf8_buffer

KINDS = ("assign", "access", "hex", "random")
MIN_RUN = 20
FDR = 0.01
MASK = "[SECRET]"

_ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_RUN)
#: Shortest whole match of ``access``; no text without a run as long has one.
_LEAST_RUN = 16

#: Characters of the candidates and of both base patterns without keywords.
_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True

_ALPHABETS = {
    "hex": b"0123456789abcdef",
    "base32": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
_VALUE = {}
for _name, _symbols in _ALPHABETS.items():
    _VALUE[_name] = np.full(256, -1, np.int64)
    _VALUE[_name][list(_symbols)] = np.arange(len(_symbols))
#: Group of each symbol (capital, small letter, digit, mark) and the groups' shares.
_GROUP = {
    name: np.array([0 if 65 <= c <= 90 else 1 if 97 <= c <= 122 else 2 if 48 <= c <= 57 else 3 for c in symbols])
    for name, symbols in _ALPHABETS.items()
}
_GROUP_SHARE = {name: np.bincount(g, minlength=4) / len(g) for name, g in _GROUP.items()}
_VALUE["hex"][list(b"ABCDEF")] = np.arange(10, 16)
_VALUE["base64"][list(b"-_")] = (62, 63)


def encoding(run: bytes) -> str | None:
    """The smallest alphabet that holds ``run``; None unless it mixes letters and
    digits (words, paths and plain numbers aren't encodings)."""
    run = run.rstrip(b"=")
    if not re.search(rb"[0-9]", run) or not re.search(rb"[A-Za-z]", run):
        return None
    if re.fullmatch(rb"[0-9a-f]+|[0-9A-F]+", run):
        return "hex"
    return "base32" if re.fullmatch(rb"[A-Z2-7]+", run) else "base64"


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_squared(counts: np.ndarray, want: np.ndarray) -> float:
    counts, want = counts[want > 0], want[want > 0]
    df = len(want) - 1
    chi = float(((counts - want) ** 2 / want).sum())
    # Wilson and Hilferty's cube root makes the statistic close to normal.
    return _upper(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def p_random(run: bytes, kind: str) -> float:
    """Combined p-value of the battery for uniform draws of the alphabet."""
    symbols = len(_ALPHABETS[kind])
    x = _VALUE[kind][np.frombuffer(run.rstrip(b"="), np.uint8)]
    n = len(x)
    p_chi = _chi_squared(np.bincount(x, minlength=symbols), np.full(symbols, n / symbols))
    p_groups = _chi_squared(np.bincount(_GROUP[kind][x], minlength=4), n * _GROUP_SHARE[kind])
    high = x >= symbols // 2
    a, b = int(high.sum()), int(n - high.sum())
    p_runs = 1.0
    if a and b:
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        if var > 0:
            p_runs = 2 * _upper(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var))
    else:
        p_runs = 2.0 ** (1 - n)
    y = x - x.mean()
    spread = float((y * y).sum())
    p_serial = 0.0
    if spread > 0:
        r = float((y[1:] * y[:-1]).sum()) / spread
        p_serial = 2 * _upper(abs(r + 1 / n) * math.sqrt(n))
    return min(1.0, 4 * min(p_chi, p_groups, p_runs, p_serial))


def stratum(kind: str, length: int) -> str:
    """Encoding and length band (powers of the square root of two)."""
    return f"{kind}/{int(2 * math.log2(length))}"


_BINS = 400  # of -log10 p, each a tenth wide


def _bin(p: float) -> int:
    return _BINS - 1 if p <= 0 else min(_BINS - 1, max(0, int(-10 * math.log10(p))))


def _long_runs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows hold a run of at least ``_LEAST_RUN`` characters in ``_RUN``."""
    base = int(offsets[0])
    inside = np.zeros(int(offsets[-1]) - base + 2, np.int8)
    inside[1:-1] = _RUN[data[base : offsets[-1]]]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts = edge[::2][edge[1::2] - edge[::2] >= _LEAST_RUN] + base
    # A run that reaches over a boundary of texts marks both; the patterns decide.
    ends = edge[1::2][edge[1::2] - edge[::2] >= _LEAST_RUN] + base - 1
    out = np.zeros(len(offsets), bool)
    first = np.searchsorted(offsets, starts, side="right") - 1
    last = np.searchsorted(offsets, ends, side="right") - 1
    for a, b in zip(first.tolist(), last.tolist()):
        out[a : b + 1] = True
    return out[: len(offsets) - 1]


def base_spans(text: bytes, long_run: bool) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes."""
    out = []
    low = text.lower()
    if b"passw" in low or b"secret" in low or b"token" in low or b"api" in low:
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if long_run:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
        out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(out, key=lambda s: (s[0], s[2]))


def candidates(text: bytes) -> list[tuple[int, int, str, float]]:
    """(start, end, stratum, p) of the runs with an inferred encoding, in bytes."""
    out = []
    for m in _CANDIDATE.finditer(text):
        kind = encoding(m[0])
        if kind:
            out.append((m.start(), m.end(), stratum(kind, len(m[0])), p_random(m[0], kind)))
    return out


def thresholds(docs: DataFrame, text_col: str = "text", fdr: float = FDR) -> dict[str, int]:
    """Per stratum the first p-value bin that Benjamini and Hochberg's step marks
    as not random, from the candidates of all documents. Strata are a few dozen,
    bins ``_BINS``: both bounds hold for any corpus."""

    def run(batches):
        counts: dict[tuple[str, int], int] = {}
        for b in batches:
            data, offsets = utf8_buffer(b.column(0))
            for i in np.flatnonzero(_long_runs(data, offsets)).tolist():
                for _, _, where, p in candidates(data[offsets[i] : offsets[i + 1]].tobytes()):
                    counts[where, _bin(p)] = counts.get((where, _bin(p)), 0) + 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in counts], pa.string()),
                pa.array([k[1] for k in counts], pa.int64()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            ["stratum", "bin", "n"],
        )

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "stratum string, bin bigint, n bigint")
    by: dict[str, dict[int, int]] = {}
    for r in parts.groupBy("stratum", "bin").agg(F.sum("n").alias("n")).collect():
        by.setdefault(r.stratum, {})[r.bin] = r.n
    out = {}
    for where, counts in by.items():
        total, below, first = sum(counts.values()), 0, _BINS
        for k in sorted(counts, reverse=True):
            below += counts[k]
            if 10 ** (-k / 10) <= fdr * below / total:  # the bin's largest p
                first = k
        out[where] = first
    return out


def all_spans(text: bytes, long_run: bool, limits: dict[str, int]) -> list[tuple[int, int, int]]:
    """Base spans, and the random runs that meet none of them, by start."""
    base = base_spans(text, long_run)
    out = list(base)
    if long_run:
        for a, b, where, p in candidates(text):
            if _bin(p) < limits.get(where, _BINS) and all(b <= s or e <= a for s, e, _ in base):
                out.append((a, b, 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: dict[str, int] | None = None
) -> DataFrame:
    """Per document row: id, and all spans as (kind, start, end) in code points."""
    spark = docs.sparkSession
    prepare(spark)
    cut = spark.sparkContext.broadcast(thresholds(docs, text_col) if limits is None else limits)
    need = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for b in batches:
            data, offsets = utf8_buffer(b.column(1))
            found = []
            for i, long_run in enumerate(_long_runs(data, offsets).tolist()):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                spans = all_spans(text, long_run, cut.value)
                found.append(
                    [{"kind": KINDS[k], "start": code_points(text, a), "end": code_points(text, e)} for a, e, k in spans]
                )
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(span))], ["doc_id", "spans"])

    id_type = need.schema["doc_id"].dataType.simpleString()
    return need.mapInArrow(run, f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with every found span replaced by ``mask``; of an assignment only
    the value goes. Rows, columns and clean texts stay as they are."""
    spark = docs.sparkSession
    prepare(spark)
    cut = spark.sparkContext.broadcast(thresholds(docs, text_col))
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            column = b.column(at)
            data, offsets = utf8_buffer(column)
            texts = column.to_pylist()
            for i, long_run in enumerate(_long_runs(data, offsets).tolist()):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                spans = all_spans(text, long_run, cut.value)
                if spans:
                    texts[i] = _masked(text, spans, mask.encode()).decode("utf-8", "surrogatepass")
            new = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _masked(text: bytes, spans: list[tuple[int, int, int]], mask: bytes) -> bytes:
    out, done = [], 0
    for a, b, kind in spans:
        if kind == 0:
            a = _ASSIGN.match(text, a).start(2)
        if b <= done:
            continue
        if a >= done:
            out += [text[done:a], mask]
        done = b
    return b"".join([*out, text[done:]])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; counts and digests of the spans."""
    found = scan(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def n(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def brute_force_base(text: str | None) -> tuple[list[tuple[int, int, str]], str]:
    """The contract's base spans with plain patterns over code points; for tests."""
    text = text or ""
    assign = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), m.end(), "assign") for m in re.finditer(assign, text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in out).encode()).hexdigest()
