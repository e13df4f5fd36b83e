"""Operator 1, toxicity of restored text.

Noisy-channel deobfuscation: a token with digits or symbols among its letters,
with a letter three times or more in a row, or a row of single letters, becomes a
lattice of what it may stand for (leetspeak, repetition, separators, spacing),
each way with a channel cost. Viterbi over the character 4-gram model of
``charmodel`` (counted by Spark over all documents) picks the likeliest reading.
Other tokens have one reading. Only the restored text is scored.

Scoring: the features of a word are the word and its first 4, 5 and 6 letters,
hashed into ``BUCKETS`` buckets. Spark counts, over the learning documents, how
many toxic and clean ones hold each; a bucket's weight is a cautious bound
of the log-odds of its toxic share over the overall share. A document's largest word weights and
their number go into a logistic regression, fitted on learning documents that the
counts haven't seen (at most ``FIT_ROWS`` of them).

Learning never sees documents whose crc32(id as text) mod 4 is 2; remainders 0
and 1 are counted, 3 is for the regression. Label, language, source and id are no
inputs of a score.

Defined results: null and empty texts have no words and get the regression's
score for none; repeated label rows of a document count as toxic if any is;
repeated documents are scored row by row (the same text, the same score); without
labels every score is 0.1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.llm import charmodel
from prefspark.llm.common import prepare, saved, table, texts_of

BUCKETS = 1 << 20
SHRINK = 2.0
#: Standard errors taken off a bucket's log-odds: what few documents say counts less.
CAUTION = 1.5
FIT_ROWS = 50_000
THRESHOLD = 0.3
MAX_CACHED = 300_000

#: What a character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
_EDGE_FRONT = "\"'([{<*#&%-_.,;:?/\\|"
_EDGE_BACK = "\"')]}>*#&%-_.,;:?!/\\|"
#: Channel costs in nats.
_SWAP, _DROP, _ONCE, _TWICE, _BREAK = 1.0, 1.5, 0.5, 1.0, 2.0
_SPACE = 29


class Decoder:
    """Viterbi decoding of token lattices under the character model."""

    def __init__(self, model: charmodel.Model):
        self.model = model
        self.known: dict[str, tuple[str, ...]] = {}
        self.costs: dict[int, float] = {}
        self.classes: dict[str, int] = {}

    def _class(self, c: str) -> int:
        k = self.classes.get(c)
        if k is None:
            k = self.classes[c] = int(charmodel._CLASS[ord(c)])
        return k

    def _cost(self, key: int) -> float:
        x = self.costs.get(key)
        if x is None:
            x = self.costs[key] = float(self.model.nll(np.array([key], np.uint32))[0])
        return x

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        out, i = [], 0
        while i < len(token):
            c, j = token[i], i
            while j < len(token) and token[j] == c:
                j += 1
            n, i = j - i, j
            if c.isalpha():
                ways = [(c, 0.0)] if n == 1 else [(c, _ONCE if n > 2 else 4 * _TWICE), (c + c, _TWICE if n > 2 else 0.0)]
            else:
                ways = [(x, _SWAP) for x in LEET.get(c, "")]
                ways += [(2 * x, _SWAP + _TWICE) for x in LEET.get(c, "") if n > 1]
                ways.append((c * n, 0.0) if c.isdigit() else ("", _DROP))
                if not c.isdigit():
                    ways.append((" ", _BREAK))
            out.append(ways)
        return out

    def best(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The cheapest reading; ties go to the way named first."""
        start = (_SPACE << 12) | (_SPACE << 6) | _SPACE
        states: dict[int, tuple[float, str]] = {start: (0.0, "")}
        for ways in [*lattice, [(" ", 0.0)]]:
            after: dict[int, tuple[float, str]] = {}
            for context, (cost, text) in states.items():
                for emit, price in ways:
                    at, total = context, cost + price
                    for c in emit:
                        key = (at << 6) | self._class(c)
                        total += self._cost(key)
                        at = key & 0x3FFFF
                    if at not in after or total < after[at][0]:
                        after[at] = (total, text + emit)
            states = after
        return min(states.values())[1].strip()

    def token(self, token: str) -> tuple[str, ...]:
        """The words that a token stands for."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= MAX_CACHED:
                self.known.clear()
            found = self.known[token] = self._token(token)
        return found

    def _token(self, token: str) -> tuple[str, ...]:
        for c in "$@!+(":  # one at an edge may be a letter, several are decoration
            if token.startswith(c + c):
                token = token.lstrip(c)
            if token.endswith(c + c):
                token = token.rstrip(c)
        token = token.lstrip(_EDGE_FRONT).rstrip(_EDGE_BACK)
        letters = sum(map(str.isalpha, token))
        if not letters:
            return ()
        if letters == len(token) and not any(token[k] == token[k - 1] == token[k - 2] for k in range(2, len(token))):
            return (token,)
        digits = sum(map(str.isdigit, token))
        if digits > letters and len(token) > 8:  # a number or a code, not a disguised word
            return (token,)
        return tuple(self.best(self.lattice(token)).split())

    def words(self, text: bytes) -> set[str]:
        """The distinct words of the restored text."""
        tokens = text.decode("utf-8", "surrogatepass").lower().split()
        distinct = set(tokens)
        found = list(map(self.known.get, distinct))
        if None in found:
            found = list(map(self.token, distinct))
        out: set[str] = set().union(*found)
        if 1 in map(len, distinct):
            out.update(self._spaced(tokens))
        return out

    def _spaced(self, tokens: list[str]):
        """Words spelt with single characters, three or more in a row."""
        single = [k for k, t in enumerate(tokens) if len(t) == 1]
        first = 0
        for k in range(1, len(single) + 1):
            if k == len(single) or single[k] != single[k - 1] + 1:
                if k - first >= 3:
                    row = "".join(tokens[single[first] : single[k - 1] + 1])
                    if any(map(str.isalpha, row)):
                        ways = self.lattice(row)
                        yield from self.best([[(x + y, p + q) for x, p in w for y, q in (("", 0.0), (" ", _BREAK))] for w in ways]).split()
                first = k

    def readings(self, text: str) -> str:
        """The restored text, token by token; spelt-out rows are joined."""
        tokens = text.lower().split()
        out, k = [], 0
        while k < len(tokens):
            j = k
            while j < len(tokens) and len(tokens[j]) == 1:
                j += 1
            if j - k >= 3:
                out += list(self._spaced(tokens[k:j])) or tokens[k:j]
                k = j
            else:
                out += self.token(tokens[k])
                k += 1
        return " ".join(out)


def features(word: str) -> list[int]:
    parts = {b"=" + word.encode("utf-8", "surrogatepass")}
    parts.update(b"^" + word[:n].encode("utf-8", "surrogatepass") for n in (4, 5, 6) if len(word) >= n)
    return [zlib.crc32(p) % BUCKETS for p in parts]


class Lexicon:
    """Word weights from the buckets' weights."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.known: dict[str, float] = {}

    def of(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            if len(self.known) >= MAX_CACHED:
                self.known.clear()
            w = self.known[word] = float(self.weights[features(word)].max())
        return w

    def inputs(self, words: set[str]) -> list[float]:
        """What the regression sees: the largest weights and their number."""
        found = list(map(self.known.get, words))
        if None in found:
            found = list(map(self.of, words))
        found.sort()
        first = [max(x, 0.0) for x in (found[:-4:-1] + [0.0] * 3)[:3]]
        strong = len(found) - bisect.bisect_right(found, 2.0)
        return [*first, np.log1p(strong), strong / np.sqrt(len(words) + 1)]


_HELD: dict[str, object] = {}


def _held(name: str, make):
    """An object that a worker's tasks share, with what it has cached; the two last ones."""
    if name not in _HELD:
        if len(_HELD) >= 2:
            _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def _count(rows: DataFrame, model) -> tuple[np.ndarray, np.ndarray]:
    """Per bucket the toxic and the clean documents that hold it."""

    name = f"decoder {model.value.name}"

    def run(batches):
        decoder = _held(name, lambda: Decoder(model.value))
        known: dict[str, list[int]] = {}
        held = np.zeros((2, BUCKETS), np.int32)
        docs = np.zeros(2, np.int64)
        for b in batches:
            for text, toxic in zip(texts_of(b.column("text")), b.column("toxic").to_pylist()):
                side = 1 if toxic else 0
                words = decoder.words(text)
                parts = list(map(known.get, words))
                if None in parts:
                    if len(known) >= MAX_CACHED:
                        known.clear()
                    parts = [known.get(w) or known.setdefault(w, features(w)) for w in words]
                held[side, list(set().union(*parts))] += 1
                docs[side] += 1
        at = np.flatnonzero(held.any(axis=0))
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), *(pa.array(held[s, part].astype(np.int64)) for s in (1, 0))], ["bucket", "toxic", "clean"]
            )
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int32()), pa.array([docs[1]], pa.int64()), pa.array([docs[0]], pa.int64())], ["bucket", "toxic", "clean"]
        )

    parts = rows.mapInArrow(run, "bucket int, toxic bigint, clean bigint")
    total = parts.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    counts = np.zeros((2, BUCKETS + 1), np.int64)  # the last entry: all documents
    at = total.column("bucket").to_numpy()
    for side, name in ((1, "toxic"), (0, "clean")):
        counts[side, at] = total.column(name).to_numpy()
    return counts[1], counts[0]


def _weights(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    share = (toxic[-1] + 1) / (toxic[-1] + clean[-1] + 2)
    t, c = toxic[:-1] + SHRINK * share, clean[:-1] + SHRINK * (1 - share)
    return (np.log(t / c) - np.log(share / (1 - share)) - CAUTION * np.sqrt(1 / t + 1 / c)).astype(np.float32)


def _regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[1.0] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _scored(rows: DataFrame, keep: list[str], model, weights, beta) -> DataFrame:
    """``keep`` with the inputs (without ``beta``) or the score of each text."""

    name, made = f"decoder {model.value.name}", uuid.uuid4().hex

    def run(batches):
        decoder, lexicon = _held(name, lambda: Decoder(model.value)), _held(made, lambda: Lexicon(weights.value))
        for b in batches:
            x = np.array([lexicon.inputs(decoder.words(t)) for t in texts_of(b.column("text"))]).reshape(-1, 5)
            if beta is None:
                new = pa.array(x.tolist(), pa.list_(pa.float64()))
            else:
                new = pa.array(1 / (1 + np.exp(-(beta[0] + x @ beta[1:]))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), new], [*keep, "out"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(run, f"{types}, out {'array<double>' if beta is None else 'double'}")


def learn(docs: DataFrame, labels: DataFrame, model):
    """(bucket weights, regression) from (doc_id, text) and (doc_id, toxic)."""
    spark = docs.sparkSession
    fold = fold_of(F.col("doc_id"))
    marks = labels.where(F.col("toxic").isNotNull() & (fold != 2)).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    # Texts are joined by a merge at every size: labels have no proven bound.
    rows = saved(docs.where(fold != 2).join(marks.hint("merge"), "doc_id").select("text", "toxic", fold.alias("fold"), F.xxhash64("doc_id").alias("h")))
    toxic, clean = _count(rows.where("fold <> 3").select("text", "toxic"), model)
    weights = spark.sparkContext.broadcast(_weights(toxic, clean))
    fit = _scored(rows.where("fold = 3").select("text", "toxic", "h"), ["toxic", "h"], model, weights, None)
    sample = fit.orderBy("h").limit(FIT_ROWS).toArrow()
    y = sample.column("toxic").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return weights, np.array([np.log(0.1 / 0.9), 0, 0, 0, 0, 0])
    return weights, _regression(np.array(sample.column("out").to_pylist()), y)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, held_out, score (0 to 1), predicted."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fitted = charmodel.fit(rows, "text")
    fitted.name = uuid.uuid4().hex  # tells the tasks' decoders of different models apart
    model = spark.sparkContext.broadcast(fitted)
    weights, beta = learn(rows, labels.select("doc_id", "toxic"), model)
    out = _scored(rows, ["doc_id"], model, weights, beta)
    held = F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("out").alias("score"), (F.col("out") >= THRESHOLD).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
