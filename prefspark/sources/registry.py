"""S14 dataset registry: name -> builder of the two long-form tables of a
dataset, ``sft`` (prompt, sft_target, first_ord) and ``pairs`` (prompt,
first_ord, pair_ix, chosen, rejected). Users can add builders to ``DATASETS``."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.operators import epochs
from prefspark.session import materialize
from prefspark.sources import dialogue, io, records
from prefspark.sources.fixtures import table, view

PAIR_SCHEMA = T.StructType([
    T.StructField("prompt", T.StringType()),
    T.StructField("first_ord", T.LongType()),
    T.StructField("pair_ix", T.LongType()),
    T.StructField("chosen", T.StringType()),
    T.StructField("rejected", T.StringType()),
])
SFT_SCHEMA = T.StructType([
    T.StructField("prompt", T.StringType()),
    T.StructField("sft_target", T.StringType()),
    T.StructField("first_ord", T.LongType()),
])

# Datasets whose prompts are truncated from the left (keep the end).
KEEP_END = ("hh", "sharegpt")


class Dataset:
    """A named dataset's two tables, conformed to the record schemas on first
    access (a table given as a callable is built only then)."""

    def __init__(self, name: str, sft, pairs):
        self.name = name
        self._sft = sft
        self._pairs = pairs

    @cached_property
    def sft(self) -> DataFrame:
        return _conform(self._sft() if callable(self._sft) else self._sft, SFT_SCHEMA)

    @cached_property
    def pairs(self) -> DataFrame:
        if self._pairs is None:
            raise ValueError(f"dataset '{self.name}' has no preference pairs")
        return _conform(self._pairs() if callable(self._pairs) else self._pairs, PAIR_SCHEMA)

    @property
    def has_pairs(self) -> bool:
        return self._pairs is not None

    @property
    def truncation_mode(self) -> str:
        return "keep_end" if self.name in KEEP_END else "keep_start"


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _pairs_with_first(pairs: DataFrame) -> DataFrame:
    """``first_ord`` of a prompt, the place of its first pair; one row per prompt on
    the right, so that a prompt with many pairs can be split."""
    first = pairs.where("pair_ix = 0").select(F.col("prompt").alias("_prompt"), F.col("ord").alias("first_ord"))
    return pairs.join(first, F.col("prompt").eqNullSafe(F.col("_prompt"))).drop("_prompt")


# Builders return the two tables, or zero-argument callables for tables whose
# construction runs jobs (position counts, checkpoints): those are built only
# when a caller reads them.
def _hh(spark, sf_dir, split, **kw):
    hh = view(spark, sf_dir, "v_hh")
    return (lambda: records.hh_sft_target(hh)), (lambda: _pairs_with_first(records.hh_pairs(hh)))


def _shp(spark, sf_dir, split, **kw):
    shp = view(spark, sf_dir, "v_shp")
    return (lambda: records.shp_sft_target(shp)), (lambda: _pairs_with_first(records.shp_pairs(shp)))


def _se_answers(spark, sf_dir, split, strip_html=False, answers=None, **kw):
    # The fixture bodies are plain text, where T2 would empty them: strip only
    # when the source is HTML.
    ans = records.se_split(view(spark, sf_dir, "v_answers") if answers is None else answers, split)
    return records.se_clean(ans) if strip_html else ans


def _se(spark, sf_dir, split, **kw):
    # The pairs of scored answers are never written as a table; preference
    # training draws its batches from them (pair_sets, pair_batches).
    return (lambda: records.se_sft_target(_se_answers(spark, sf_dir, split, **kw))), None


def _sharegpt(spark, sf_dir, split, prefs=None, num_turns=1, data_fraction=1.0, **kw):
    if prefs is not None:
        rec = records.aiprefs(prefs, split, data_fraction)
        pairs = rec.select("prompt", "first_ord", F.lit(0).alias("pair_ix"), "chosen", "rejected")
        return rec.select("prompt", "sft_target", "first_ord"), pairs
    sft = dialogue.sharegpt_sft(view(spark, sf_dir, "v_turns"), split, num_turns, data_fraction)
    return sft, None


def _ultrafeedback(spark, sf_dir, split, **kw):
    rec = records.binarized(view(spark, sf_dir, "v_binarized").filter(F.col("source") == "wide"), split)
    return (rec.select("prompt", "sft_target", "first_ord"),
            rec.select("prompt", "first_ord", F.lit(0).alias("pair_ix"), "chosen", "rejected"))


def _ultrafeedbacknarrow(spark, sf_dir, split, **kw):
    rec = records.binarized_narrow(view(spark, sf_dir, "v_binarized"), split)
    return (rec.select("prompt", "sft_target", "first_ord"),
            rec.select("prompt", "first_ord", F.lit(0).alias("pair_ix"), "chosen", "rejected"))


def _ultrachat(spark, sf_dir, split, **kw):
    return dialogue.ultrachat_first_turn(view(spark, sf_dir, "v_turns")), None


def _wiki(spark, sf_dir, split, fixed_ord=25, **kw):
    docs = table(spark, sf_dir, "documents")
    return (lambda: records.wikitext(docs, split, fixed_ord=fixed_ord)), None


def _alpaca(spark, sf_dir, split, **kw):
    return records.alpaca_prompts(table(spark, sf_dir, "benchmark")), None


def _completion_maps(suffix: str, test_n: int):
    """SFT records from teacher completion maps: ``maps`` rows shaped like
    ``io.read_completion_maps`` output, or files ``<maps_dir>/*<suffix>``."""

    def build(spark, sf_dir, split, maps=None, maps_dir=None, data_fraction=1.0, **kw):
        if maps is None:
            if maps_dir is None:
                raise ValueError("completion maps are needed: pass maps= or maps_dir=")
            maps = io.read_completion_maps(spark, maps_dir, f"*{suffix}")
        return (lambda: records.completion_map_sft(maps, split, data_fraction, test_n)), None

    return build


DATASETS: dict[str, Callable] = {
    "shareclaude": _completion_maps("claude_completions.json", 256),
    "sharegpt4": _completion_maps("gpt4_completions.json", 512),
    "shp": _shp,
    "hh": _hh,
    "se": _se,
    "wiki": _wiki,
    "sharegpt": _sharegpt,
    "ultrachat": _ultrachat,
    "ultrafeedback": _ultrafeedback,
    "ultrafeedbacknarrow": _ultrafeedbacknarrow,
    "alpaca_eval": _alpaca,
}


def get_dataset(spark: SparkSession, sf_dir: str, name: str, split: str = "train", **kw) -> Dataset:
    """Build a dataset by name; unknown names raise; both tables are
    conformed to the record schemas (the reference checks the record keys)."""
    if name not in DATASETS:
        raise ValueError(f"Unknown dataset '{name}'")
    sft, pairs = DATASETS[name](spark, sf_dir, split, **kw)
    return Dataset(name, sft, pairs)


def pair_sets(spark: SparkSession, sf_dir: str, names: list[str], split: str = "train", **kw):
    """U1 in preference mode: the pair set of each dataset. Scored answers have theirs
    as a space of positions, the others as rows; datasets without pairs raise."""
    out = []
    for name in names:
        if name == "se":
            out.append(records.ScoredPairs(_se_answers(spark, sf_dir, split, **kw)))
            continue
        own = {**kw, "prefs": view(spark, sf_dir, "v_annotations")} if name == "sharegpt" and "prefs" not in kw else kw
        out.append(records.ListedPairs(get_dataset(spark, sf_dir, name, split, **own).pairs))
    return out


class PairBatches:
    """Preference training over several datasets: any batch of any epoch, without
    building what comes before it."""

    def __init__(self, spark: SparkSession, sf_dir: str, names: list[str], split: str = "train", seed: int = 0,
                 shuffle: bool = True, **kw):
        self.names, self._sets = names, pair_sets(spark, sf_dir, names, split, **kw)
        groups = [s.groups.withColumn("dataset_ix", F.lit(ix)) for ix, s in enumerate(self._sets)]
        every = groups[0]
        for g in groups[1:]:
            every = every.unionByName(g)
        self.schedule = epochs.Schedule(every, ["dataset_ix", "first_ord"], seed, shuffle)

    @property
    def n(self) -> int:
        """Pairs in an epoch."""
        return self.schedule.n

    def batches(self, numbers: list[int], batch_size: int, n_epochs: int = 1) -> DataFrame:
        """The rows of the given batches (from 0) of each epoch; batches beyond the last
        whole one have none."""
        ranges = epochs.batch_ranges(self.n, batch_size, numbers)
        drawn = self.schedule.drawn(n_epochs, ranges or [(0, 0)])
        place = F.col("rn") - 1
        drawn = materialize(drawn.withColumn("batch_id", F.call_function("div", place, F.lit(batch_size))).withColumn(
            "pos_in_batch", F.pmod(place, F.lit(batch_size))))
        out = None
        for ix, (name, pairs) in enumerate(zip(self.names, self._sets)):
            rows = pairs.rows(drawn.where(F.col("dataset_ix") == ix)).withColumn("dataset", F.lit(name))
            out = rows if out is None else out.unionByName(rows)
        mode = {n: "keep_end" if n in KEEP_END else "keep_start" for n in self.names}
        ends = F.col("dataset").isin([n for n, m in mode.items() if m == "keep_end"])
        return out.withColumn("truncation_mode", F.when(ends, "keep_end").otherwise("keep_start"))


def mixture(spark: SparkSession, sf_dir: str, names: list[str], split: str = "train", mode: str = "pairs", **kw) -> DataFrame:
    """Rows of several datasets stacked (no cross-dataset dedupe), each tagged
    with its dataset, its place in the list and its truncation mode. ``mode`` is
    ``pairs`` (preference training) or ``sft`` (one row per prompt). A dataset
    without pairs can't be trained on in preference mode: that is an error."""
    if mode not in ("pairs", "sft"):
        raise ValueError(f"Unknown mode '{mode}'")
    out = None
    for ix, name in enumerate(names):
        own = {**kw, "prefs": view(spark, sf_dir, "v_annotations")} if name == "sharegpt" and mode == "pairs" and "prefs" not in kw else kw
        ds = get_dataset(spark, sf_dir, name, split, **own)
        if mode == "pairs" and not ds.has_pairs:
            raise ValueError(f"dataset '{name}' has no table of preference pairs; use mode='sft', or PairBatches for scored answers")
        rows = ds.pairs if mode == "pairs" else ds.sft
        part = rows.select(F.lit(name).alias("dataset"), F.lit(ix).alias("dataset_ix"), "*", F.lit(ds.truncation_mode).alias("truncation_mode"))
        out = part if out is None else out.unionByName(part)
    return out
