"""Operator 9, quality rules with n-gram perplexity.

Base rules count words, symbols, repeated lines and repeated 3-word windows. On
top, a modified Kneser-Ney model per language over n-grams of ``ORDER`` characters,
counted by Spark over every document, gives each text a perplexity; each language has
a lower and an upper band around its median, and a text outside is rejected.

Characters are code points as they stand, of any script. Counts, continuation counts,
discounts and interpolated probabilities are tables that Spark groups and joins; the
model grows with the corpus and is neither collected nor broadcast:

1. ``_packed`` deals the rows, in the order in which they are read, into units of about
   ``UNIT_BYTES`` of text and saves them as compressed Arrow batches;
2. ``_grams``: each unit's different n-grams with their counts;
3. ``_model``: their sums, the units each occurs in, and its probability;
4. each unit gets the n-grams it holds back, as a sorted array of 64-bit hashes, and
   scores its texts.

An n-gram that occurs once in its whole language is scored as if the text were not
part of the corpus (leave one out): by the shorter n-gram. Otherwise every text would
vouch for itself, and random letters would look like prose.

Bands: per language, the median of the mean negative log-probability +-
``BAND_MADS`` scaled median deviations (``BAND_LEAST`` nats at least), and one
standard error of the mean, as short texts vary more: ``CHAR_SD`` nats, about
what single characters vary by, over the root of the text's length. The ``MAX_LANGS`` most frequent languages have bands of their own; rarer ones
share one. A text shorter than ``MIN_SCORED`` characters has no verdict by
perplexity (its mean is too noisy) and passes that rule.

Defined results: a null text counts as empty (no words, so it fails the base
rule); a null language is a language of its own; repeated rows are judged row by
row; an empty table gives no rows; other columns are ignored by ``score`` and
carried unchanged by ``filter_docs``.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from prefspark.llm.charmodel import _CLASS, Model, fit, grams  # noqa: F401  (op1's model, known by these names)
from prefspark.llm.common import free_name, prepare, runs, saved, table, utf8_buffer

ORDER = 4
UNIT_BYTES = 32 << 20
#: zstd's level for the saved texts, which are written twice: saved, and dealt to the scores.
PACKED_LEVEL = 12
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BAND_MADS = 4.0
BAND_LEAST = 0.05
CHAR_SD = 1.0
MIN_SCORED = 200
MAX_LANGS = 1000
_WHITE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
#: Text in one saved blob, and of that in memory at once, with arrays of 100 times its size.
_BLOB = 4 << 20
_RUN = 1 << 18


def _language(lang_col: str):
    """Null and a language of that spelling are told apart."""
    return F.when(F.col(lang_col).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(lang_col).cast("string")))


def _packed(docs: DataFrame) -> DataFrame:
    """(unit, rows): the rows as Arrow batches of about ``_BLOB`` of text, the last column
    being the text. ``saved`` once, as units are numbered anew each time."""

    def run(batches):
        unit, held = uuid.uuid4().int >> 66, 0
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=PACKED_LEVEL))
        for b in batches:
            _, offsets = utf8_buffer(b.column(b.num_columns - 1))
            for i, j in runs(offsets, _BLOB):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=options) as out:
                    out.write_batch(b.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([pa.array([unit]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["unit", "rows"])
                held += int(offsets[j] - offsets[i])
                if held >= UNIT_BYTES:
                    unit, held = uuid.uuid4().int >> 66, 0

    return docs.mapInArrow(run, "unit bigint, rows binary")


def _unpacked(blob) -> pa.RecordBatch:
    with pa.ipc.open_stream(blob) as stream:
        return stream.read_next_batch()


def _seed(language: str) -> int:
    return int.from_bytes(hashlib.blake2b(language.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _mixed(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    h = (h ^ code) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class _Text:
    """The characters of the texts of one run, one text after the other. Every text
    starts behind ORDER - 1 pads, code 0."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, languages: list[str]):
        raw = data[offsets[0] : offsets[-1]]
        text = raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(text, np.uint32).copy()
        codes[(codes == 0) | ((codes >= 0xD800) & (codes < 0xE000))] = 0xFFFD  # 0 is the pad; lone halves
        before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets - offsets[0]]
        self.sizes = np.diff(before)
        self.codes = codes
        self.place = np.arange(len(codes)) - np.repeat(before[:-1], self.sizes)
        seeds = np.array([_seed(x) for x in languages], np.uint64)
        self.which = languages, self.sizes
        self.key = np.repeat(seeds, self.sizes)
        for back in range(ORDER - 1, -1, -1):
            self.key = _mixed(self.key, self._back(back))

    def _back(self, back: int) -> np.ndarray:
        out = np.zeros(len(self.codes), np.uint64)
        out[back:] = self.codes[: len(self.codes) - back]
        out[self.place < back] = 0
        return out

    def grams(self, at: np.ndarray) -> np.ndarray:
        """The characters of the n-grams that end at ``at``, a row each."""
        out = np.zeros((len(at), ORDER), np.uint32)
        for back in range(ORDER):
            inside = self.place[at] >= back
            out[inside, ORDER - 1 - back] = self.codes[at[inside] - back]
        return out


def _texts(batch: pa.RecordBatch):
    """(first row, last row, _Text) by runs; the languages are the last column but one."""
    data, offsets = utf8_buffer(batch.column(batch.num_columns - 1))
    languages = batch.column(batch.num_columns - 2).to_pylist()
    for i, j in runs(offsets, _RUN):
        if offsets[j] > offsets[i]:
            yield i, j, _Text(data, offsets[i : j + 1], languages[i:j])


def _merged(key, n, codes, lang):
    key, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    return key, np.bincount(inverse, n, len(key)).astype(np.int64), codes[first], lang[first]


def _grams(packed: DataFrame) -> DataFrame:
    """(unit, lang, gram, n): the n-grams of each unit, sorted for their compression. A
    unit that two tasks read has two rows for what both hold."""

    def run(batches):
        unit, names, parts = None, {}, []

        def merge():
            if len(parts) > 1:
                parts[:] = [_merged(*map(np.concatenate, zip(*parts)))]

        def out():
            merge()
            for _, n, codes, lang in parts:
                order = np.lexsort([*codes.T[::-1], lang])
                spelt = np.array(list(names), object)
                for k in range(0, len(order), 1 << 16):
                    at = order[k : k + (1 << 16)]
                    chars = np.ascontiguousarray(codes[at]).view(f"<U{ORDER}").ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), unit)), pa.array(spelt[lang[at]], pa.string()), pa.array(chars.astype(object), pa.string()), pa.array(n[at])],
                        ["unit", "lang", "gram", "n"])

        for b in batches:
            for number, blob in zip(b.column(0).to_pylist(), b.column(1)):
                if number != unit:
                    yield from out()
                    unit, names, parts = number, {}, []
                for _, _, t in _texts(_unpacked(blob.as_buffer())):
                    key, at, n = np.unique(t.key, return_index=True, return_counts=True)
                    languages, sizes = t.which
                    ids = np.array([names.setdefault(x, len(names)) for x in languages], np.int32)
                    parts.append((key, n, t.grams(at), np.repeat(ids, sizes)[at]))
                    if sum(len(p[0]) for p in parts[1:]) > max(2 * _RUN, len(parts[0][0])):
                        merge()
        yield from out()

    return packed.mapInArrow(run, "unit bigint, lang string, gram string, n bigint")


def _discounts(counted: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts per language, for counts 1, 2 and 3 or more, and
    the number of different n-grams."""
    n1, n2, n3, n4 = (F.col(f"_n{k}") for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    own = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, F.when(n3 > 0, 3 - 4 * y * n4 / n3).otherwise(2.0)]
    kept = [F.least(F.greatest(d, F.lit(0.05)), F.lit(k + 0.95)) for k, d in enumerate(own)]
    usual = [F.when((n1 > 0) & (n2 > 0), d).otherwise(u).alias(f"_d{k + 1}") for k, (d, u) in enumerate(zip(kept, (0.5, 0.75, 0.9)))]
    sums = counted.groupBy("lang").agg(*(F.count_if(F.col("c") == k).alias(f"_n{k}") for k in (1, 2, 3, 4)), F.count(F.lit(1)).alias("_size"))
    return sums.select(F.col("lang").alias("_l"), *usual, "_size")


def _level(counted: DataFrame, order: int, lower: DataFrame | None) -> DataFrame:
    """``counted`` (lang, gram, c, ...) with ``p``, the interpolated probability of the
    n-gram's last character, and ``q``, the same with n-grams that occur once left out."""
    d = F.broadcast(_discounts(counted))
    rows = counted.join(d, F.col("lang") == F.col("_l"))
    cut = F.when(F.col("c") == 1, F.col("_d1")).when(F.col("c") == 2, F.col("_d2")).otherwise(F.col("_d3"))
    context = Window.partitionBy("lang", F.substring("gram", 1, order - 1)) if order > 1 else Window.partitionBy("lang")
    rows = rows.withColumn("_cut", cut).withColumn("_total", F.sum("c").over(context)).withColumn("_gone", F.sum("_cut").over(context))
    if lower is None:
        less = 1 / (F.col("_size") + 1)
        rows = rows.withColumn("_p", less).withColumn("_q", less)
    else:
        less = lower.select(F.col("lang").alias("_sl"), F.col("gram").alias("_sg"), F.col("p").alias("_p"), F.col("q").alias("_q"))
        rows = rows.join(less, (F.col("lang") == F.col("_sl")) & (F.substring("gram", 2, order - 1) == F.col("_sg")))
    gamma = F.col("_gone") / F.col("_total")
    p = (F.col("c") - F.col("_cut")) / F.col("_total") + gamma * F.col("_p")
    left = F.when(F.col("_total") > 1, gamma).otherwise(1.0) * F.col("_q")
    return rows.select(*counted.columns, p.alias("p"), F.when(F.col("c") == 1, left).otherwise(p).alias("q"))


def _model(grams: DataFrame) -> DataFrame:
    """(lang, gram, c, units, p, q) over all units' n-grams. The counts of the shorter
    n-grams are in how many different longer ones they are the end."""
    counted = saved(grams.groupBy("lang", "gram").agg(F.sum("n").alias("c"), F.collect_list("unit").alias("units")))
    levels = [counted]
    for order in range(ORDER - 1, 0, -1):
        levels.append(saved(levels[-1].groupBy("lang", F.substring("gram", 2, order).alias("gram")).agg(F.count(F.lit(1)).alias("c"))))
    lower = None
    for order in range(1, ORDER + 1):
        lower = _level(levels[ORDER - order], order, lower)
        if order < ORDER:
            lower = saved(lower)
    return lower


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, bytes(range(0x80, 0xC0)) + _WHITE))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeated = 0
    if n >= 4:
        ids: dict[bytes, int] = {}
        a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        if len(ids) < n:
            size = len(ids)
            key = a[:-2] * size + a[1:-1]
            if size >= 1 << 21:  # three ids would not fit into 63 bits
                key = np.unique(key, return_inverse=True)[1]
            _, inverse, count = np.unique(key * size + a[2:], return_inverse=True, return_counts=True)
            at = np.flatnonzero(count[inverse] > 1)
            hit = np.zeros(n, bool)
            hit[at] = hit[at + 1] = hit[at + 2] = True
            repeated = int(hit.sum())
    return n, chars, symbols, dup, repeated


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measured(docs: DataFrame, text_col: str, lang_col: str, keep: list[str], new: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs``, and the base counts and the mean negative
    log-probability under the names ``new``."""
    prepare(docs.sparkSession)
    columns = docs.select(*(F.col(f"`{c}`") for c in keep))
    kept = len(keep)
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), _language(lang_col).alias(free_name([*keep, *new], "_g")),
                       F.col(text_col).alias(free_name([*keep, *new], "_text")))
    packed = saved(_packed(rows))
    per_unit = _model(_grams(packed)).select(F.explode("units").alias("unit"), "lang", "gram", F.log("q").cast("float").alias("logp"))

    def score_unit(texts: pa.Table, model: pa.Table) -> pa.Table:
        keys, logp = _sorted(model)
        out = []
        for blob in texts.column("rows"):
            b = _unpacked(blob.as_buffer())
            data, offsets = utf8_buffer(b.column(b.num_columns - 1))
            counts = np.zeros((5, b.num_rows), np.int64)
            mean = np.full(b.num_rows, np.nan)
            for i in range(b.num_rows):
                counts[:, i] = base_counts(data[offsets[i] : offsets[i + 1]].tobytes())
            for i, j, t in _texts(b):
                key, inverse = np.unique(t.key, return_inverse=True)
                at = np.searchsorted(keys, key)
                if at[-1] == len(keys) or (keys[at] != key).any():
                    raise ValueError("a unit lacks some of its n-grams")
                ends = np.concatenate([[0], np.cumsum(t.sizes)])
                total = np.concatenate([[0.0], np.cumsum(-logp[at][inverse], dtype=np.float64)])[ends]
                mean[i:j] = np.where(t.sizes >= MIN_SCORED, np.diff(total) / np.maximum(t.sizes, 1), np.nan)
            arrays = [*(b.column(k) for k in range(kept)), *map(pa.array, counts), pa.array(mean, from_pandas=True)]
            out.append(pa.RecordBatch.from_arrays(arrays, [*keep, *new]))
        return pa.Table.from_batches(out)

    schema = columns.schema
    for c in new[:-1]:
        schema = schema.add(c, LongType())
    return packed.groupBy("unit").cogroup(per_unit.groupBy("unit")).applyInArrow(score_unit, schema.add(new[-1], DoubleType()))


def _sorted(model: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a unit's n-grams, ascending, and their log-probabilities."""
    spelt = model.column("lang").combine_chunks().dictionary_encode()
    if isinstance(spelt, pa.ChunkedArray):
        spelt = spelt.combine_chunks()
    key = np.array([_seed(x) for x in spelt.dictionary.to_pylist()], np.uint64)[spelt.indices.to_numpy()] if len(spelt) else np.zeros(0, np.uint64)
    data, offsets = utf8_buffer(model.column("gram"))  # all of ORDER characters
    spelt = data[offsets[0] : offsets[-1]].tobytes().decode("utf-8").encode("utf-32-le")
    codes = np.frombuffer(spelt, np.uint32).reshape(-1, ORDER)
    for k in range(ORDER):
        key = _mixed(key, codes[:, k].astype(np.uint64))
    key, first = np.unique(key, return_index=True)
    return key, model.column("logp").to_numpy()[first]


def _bands(measured: DataFrame, lang: str, nll: str) -> DataFrame:
    """Per group of languages: lower and upper mean negative log-probability."""
    scored = measured.where(F.col(nll).isNotNull())
    medians = scored.groupBy(lang).agg(F.percentile_approx(nll, 0.5, 10000).alias("_m"))
    medians = F.broadcast(medians.select(F.col(lang).alias("_l"), "_m"))
    apart = scored.join(medians, F.col(lang) == F.col("_l")).groupBy("_l", "_m")
    mad = apart.agg(F.percentile_approx(F.abs(F.col(nll) - F.col("_m")), 0.5, 10000).alias("_d"))
    reach = F.greatest(F.lit(BAND_LEAST), F.col("_d") * 1.4826 * BAND_MADS)
    return mad.select("_l", (F.col("_m") - reach).alias("_low"), (F.col("_m") + reach).alias("_high"))


def _verdicts(measured: DataFrame, lang_col: str, new: dict[str, str]) -> DataFrame:
    """``measured`` with base_failed and kept (under the names in ``new``)."""
    # The group of a language: itself, or one for all beyond the most frequent.
    lang = _language(lang_col)
    common = measured.groupBy(lang.alias("l")).count().orderBy(F.desc("count"), "l").limit(MAX_LANGS)
    names = [r.l for r in common.collect()]
    group = F.when(lang.isin(names), lang).otherwise(F.lit("*"))
    bands = _bands(measured.select(group.alias("_g"), F.col(new["nll"]).alias("_x")), "_g", "_x")
    bands = bands.collect()  # at most MAX_LANGS + 1 rows
    low = F.create_map(*(F.lit(v) for r in bands for v in (r._l, r._low))) if bands else None
    high = F.create_map(*(F.lit(v) for r in bands for v in (r._l, r._high))) if bands else None
    n, rep, nll = F.col(new["n_words"]), F.col(new["n_repeat_words"]), F.col(new["nll"])
    failed = (n < MIN_WORDS) | (100 * rep > MAX_REPEAT_PERCENT * n)
    short = CHAR_SD / F.sqrt(F.greatest(n + F.col(new["word_chars"]), F.lit(1)))
    inside = nll.isNull() | nll.between(low[group] - short, high[group] + short) if bands else F.lit(True)
    return measured.withColumn(new["kept"], ~failed & inside).withColumn(new["base_failed"], failed)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document row: doc_id, base counts, base_failed, perplexity (null where
    the text is too short for one) and kept."""
    need = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    new = [*_COUNTS, "nll"]
    narrow = saved(_measured(need, "text", "lang", ["doc_id", "lang"], new))
    out = _verdicts(narrow, "lang", {c: c for c in [*new, "base_failed", "kept"]})
    return out.select("doc_id", *_COUNTS, "base_failed", F.exp("nll").alias("perplexity"), "kept")


def filter_docs(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that pass, with their columns as they came."""
    taken, new = list(docs.columns), {}
    for c in [*_COUNTS, "nll", "base_failed", "kept"]:
        new[c] = free_name(taken, c)
        taken.append(new[c])
    measured = _measured(docs, text_col, lang_col, docs.columns, [new[c] for c in [*_COUNTS, "nll"]])
    out = _verdicts(saved(measured), lang_col, new)
    return out.where(F.col(new["kept"])).select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
