"""The character model of op1's decoder: modified Kneser-Ney over 4-grams of 64
classes of characters, a closed alphabet that the decoder's lattices are made for.
(op9's perplexity has its own model, over whole characters: ``quality``.)

Characters fall into 64 classes (letters, digits, spaces, common marks, groups
of accented and other letters; all capitals are one class). A 4-gram is therefore a
24-bit key, and the model is a sorted array of keys with one log-probability each
(the full interpolated value), and dense arrays for the lower orders, which are small.
Each task sends its own distinct n-grams, so what is counted and shuffled grows with
the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import runs, utf8_buffer

ORDER = 4
CLASSES = 64
_BITS = 6
_SPACE = 29
_SYMBOLS = b"#*$%&|<>"


def _classes() -> np.ndarray:
    """Class of every code point; the rules of the module's docstring."""
    cp = np.arange(0x110000)
    out = 57 + (cp >> 7) % 7  # other scripts, by block
    accented = (cp >= 0xC0) & (cp < 0x250)
    out[accented] = 45 + cp[accented] % 12
    out[0x80:0xC0] = 44
    out[:0x80] = 44
    out[:0x20] = 31
    out[ord("a") : ord("z") + 1] = 1 + np.arange(26)
    out[ord("A") : ord("Z") + 1] = 27
    out[ord("0") : ord("9") + 1] = 28
    out[[32, 9, 13, 11, 12]] = _SPACE
    out[10] = 30
    for k, c in enumerate(".,-'\"!?:;()"):
        out[ord(c)] = 32 + k
    for c in _SYMBOLS:
        out[c] = 43
    return out.astype(np.uint8)


_CLASS = _classes()


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the 4-grams that end at each character of the texts in ``data``
    (texts lie one after the other), and the number of characters of each text.
    Every text starts behind three pads of class 0."""
    raw = data[offsets[0] : offsets[-1]].tobytes()
    codes = _CLASS[np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)]
    lead = (data[offsets[0] : offsets[-1]] & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(lead)])[offsets - offsets[0]]
    sizes = np.diff(before)
    key = codes.astype(np.uint32)
    for back in range(1, ORDER):
        prev = np.zeros(len(codes), np.uint32)
        prev[back:] = codes[:-back] if len(codes) > back else 0
        for j in range(back):  # the first characters of a text see pads
            at = before[:-1][sizes > j] + j
            prev[at] = 0
        key |= prev << np.uint32(_BITS * back)
    return key, sizes


def count_grams(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, n) over all texts: each task sums its own, Spark sums the rest."""

    def run(batches):
        total = np.zeros(CLASSES**ORDER, np.uint32)
        seen = 0

        def out():
            keys = np.flatnonzero(total)
            for k in range(0, len(keys), 1 << 16):
                part = keys[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.astype(np.int32)), pa.array(total[part].astype(np.int64))], ["key", "n"]
                )

        for b in batches:
            data, offsets = utf8_buffer(b.column(0))
            for i, j in runs(offsets, 1 << 20):
                if offsets[j] == offsets[i]:
                    continue
                key, _ = grams(data, offsets[i : j + 1])
                seen += len(key)
                np.add.at(total, key, np.uint32(1))
                if seen > 1 << 30:  # before a counter could overflow
                    yield from out()
                    total[:] = 0
                    seen = 0
        yield from out()

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "key int, n bigint")
    return parts.groupBy("key").agg(F.sum("n").alias("n"))


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more (index 0: 0)."""
    n1, n2, n3, n4 = (int((counts == k).sum()) for k in (1, 2, 3, 4))
    if not (n1 and n2):
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
    return np.array([0, *(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))])


def _level(keys, counts, lower, width: int):
    """Interpolated probabilities of n-grams with ``counts``: (p of ``keys``,
    backoff weight of each context). ``lower``: p of the next shorter n-gram."""
    d = _discounts(counts)
    cut = d[np.minimum(counts, 3)]
    context = keys >> _BITS
    total = np.bincount(context, counts, width)
    gone = np.bincount(context, cut, width)
    gamma = np.divide(gone, total, out=np.ones(width), where=total > 0)
    p = (counts - cut) / total[context] + gamma[context] * lower[keys & (len(lower) - 1)]
    return p, gamma


class Model:
    """Modified Kneser-Ney over character classes, from sorted keys and counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys = keys.astype(np.uint32)
        p = np.full(1, 1.0 / CLASSES)
        gammas = [np.ones(1)]
        for order in range(1, ORDER + 1):
            width = CLASSES ** (order - 1)
            if order == ORDER:
                k, c = self.keys.astype(np.int64), counts
            else:  # in how many different n-grams it is the end
                longer = self.keys.astype(np.int64) & (CLASSES ** (order + 1) - 1)
                k, c = np.unique(np.unique(longer) & (CLASSES**order - 1), return_counts=True)
            seen, gamma = _level(k, c, p if order > 1 else np.full(CLASSES, p[0]), width) if len(k) else (np.zeros(0), np.ones(width))
            if order == ORDER:
                self.logp = np.log(seen).astype(np.float32)
                self.unseen3, self.gamma = np.log(p).astype(np.float32), np.log(gamma).astype(np.float32)
            else:
                full = np.repeat(gamma, CLASSES) * (p[np.arange(CLASSES**order) & (CLASSES ** (order - 1) - 1)] if order > 1 else p[0])
                full[k] = seen
                p = full
            gammas.append(gamma)

    def nll(self, key: np.ndarray) -> np.ndarray:
        """Negative log-probability of each n-gram's last character."""
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        if not len(self.keys):
            return -(self.gamma[key >> _BITS] + self.unseen3[key & (CLASSES**3 - 1)])
        out = -self.logp[at]
        new = np.flatnonzero(self.keys[at] != key)
        if len(new):
            out[new] = -(self.gamma[key[new] >> _BITS] + self.unseen3[key[new] & (CLASSES**3 - 1)])
        return out


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """The model of all texts. At most 64**4 keys come to the driver."""
    counted = count_grams(docs, text_col).toArrow()
    key, n = counted.column("key").to_numpy(), counted.column("n").to_numpy()
    order = np.argsort(key)
    return Model(key[order], n[order])
