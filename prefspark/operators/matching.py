"""Completion matching chain (section 3.2): keep-first merge of sample shards
(A5), length filter (F5), allowed-set semi-join (J2), holdout prefix (J3),
first-match join of two models (J1), comparison cap (W8), comparison rows (O3),
teacher outputs (T5, T6, K9), fast-forward (F11, F12) and the completion cache
(J4, G3, T10)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.functions import text as T
from prefspark.functions import tokens as K
from prefspark.operators import ordinals


def keep_first(samples: DataFrame, key: str = "instruction", order=("shard", "ord"),
               value: str = "output") -> DataFrame:
    """The first row per key in (file, position) order. ``min_by`` combines
    map-side, so a key repeated across many shards is reduced before the shuffle."""
    return samples.groupBy(key).agg(
        F.min_by(F.struct(*[F.col(c) for c in order], F.col(value).alias("_v")), F.struct(*order)).alias("_f")
    ).select(key, F.col("_f._v").alias(value), *[F.col(f"_f.{c}").alias(c) for c in order])


def sample_outputs(firsts: DataFrame, max_words: int = T.MAX_WORDS, max_chars: int = T.MAX_CHARS) -> DataFrame:
    """``process_llama_samples_from_dir`` over ``io.first_samples`` rows (one per
    dump entry): template-trimmed instruction (T5), first sample (W11), first
    occurrence across shards wins (A5), long instructions dropped (F5)."""
    rows = firsts.select(
        T.strip_template("prompt").alias("instruction"),
        F.col("completion").alias("output"),
        "shard", "ord",
    )
    return keep_first(rows.filter(~T.too_long("instruction", max_words, max_chars)))


def sample_outputs_from_rows(samples: DataFrame, max_words: int = T.MAX_WORDS,
                             max_chars: int = T.MAX_CHARS) -> DataFrame:
    """Same result as ``sample_outputs(io.first_samples(samples))`` in one
    aggregation: the first sample of the first entry per instruction is the
    minimum over (shard, position, sample index)."""
    rows = samples.select(
        T.strip_template("prompt").alias("instruction"),
        F.col("completion").alias("output"),
        "shard", "ord", "sample_ix",
    ).filter(~T.too_long("instruction", max_words, max_chars))
    return keep_first(rows, order=("shard", "ord", "sample_ix")).drop("sample_ix")


def too_long_count(firsts: DataFrame, max_words: int = T.MAX_WORDS, max_chars: int = T.MAX_CHARS) -> DataFrame:
    """F5+A11: one row of counts over dump entries (every too-long occurrence
    counts, as in the loop)."""
    instr = T.strip_template("prompt")
    return firsts.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.count_if(T.too_long(instr, max_words, max_chars)).cast("bigint").alias("n_too_long"),
        F.count_distinct(F.when(~T.too_long(instr, max_words, max_chars), instr)).cast("bigint").alias("n_kept"),
    )


def teacher_outputs(sft: DataFrame, max_length: int = 1024, max_prompt_length: int = 256,
                    tokenize=K.default_tokenize, decode_first=K.decode_first) -> DataFrame:
    """``get_ai_outputs``: SFT prompts in insertion order; instruction = trimmed
    template (T5); output = the text of the target tokens left after K2/K3
    truncation (T6/K9), a slice of the target with its white space. A tokenizer of one's
    own comes with its way back (``tokens.pandas_span_tokenizer``)."""
    sizes = sft.withColumn("_p", F.size(tokenize(F.col("prompt")))).withColumn("_c", F.size(tokenize(F.col("sft_target"))))
    longer = F.col("_c") + 1
    cut = F.least(F.col("_p"), F.lit(max_prompt_length)) if max_prompt_length else F.col("_p")
    left = F.when(F.col("_p") + longer <= max_length, F.col("_p")).otherwise(cut)
    kept = F.when(left + longer > max_length, F.least(F.lit(max_length - max_prompt_length), F.col("_c"))).otherwise(F.col("_c"))
    return sizes.withColumn("_k", kept).select(
        T.strip_template("prompt").alias("instruction"),
        decode_first(F.col("sft_target"), F.col("_k")).alias("output"),
        F.col("first_ord").alias("ord"),
    )


def holdout_prefix(outputs: DataFrame, k: int) -> DataFrame:
    """Drop the first ``k`` rows in ``ord`` order."""
    if k <= 0:
        return outputs
    return ordinals.dense_index(outputs, "ord", "_rn").filter(F.col("_rn") > k).drop("_rn")


def allowed_only(left: DataFrame, allowed: DataFrame, key: str = "instruction") -> DataFrame:
    """Keep rows whose key is in the allowed set."""
    return left.join(allowed.select(key), key, "left_semi")


def match_outputs(left: DataFrame, right: DataFrame, key: str = "instruction") -> DataFrame:
    """Inner equi-join; left order kept (``ord``); the right side contributes
    only its first row per key, reduced map-side before the join."""
    first_right = right.groupBy(key).agg(F.min_by("output", "ord").alias("output_2"))
    return left.select(key, F.col("output").alias("output_1"), "ord").join(first_right, key, "inner")


def cap_comparisons(matched: DataFrame, max_num: int, strict: bool = False) -> DataFrame:
    """The reference breaks after ``idx > max``, so it keeps ``max + 2`` rows;
    ``strict=True`` keeps exactly ``max``. A top-k (TakeOrderedAndProject)."""
    n = max_num if strict else max_num + 2
    return matched.orderBy("ord").limit(n)


def comparison_rows(capped: DataFrame, model1: str, model2: str) -> DataFrame:
    """O3 rows: ``{instruction, output, generator}`` for both models."""
    a = capped.select("instruction", F.col("output_1").alias("output"), F.lit(model1).alias("generator"), "ord")
    b = capped.select("instruction", F.col("output_2").alias("output"), F.lit(model2).alias("generator"), "ord")
    return a.unionByName(b)


def fast_forward(prompts: DataFrame, ff: int, order: str = "ord") -> DataFrame:
    """1-based prompt index; prompts with index < ff are skipped. Prompts that
    have their ``prompt_idx`` already are not numbered again."""
    return _numbered(prompts, order).filter(F.col("prompt_idx") >= ff)


def _numbered(prompts: DataFrame, order: str) -> DataFrame:
    return prompts if "prompt_idx" in prompts.columns else ordinals.dense_index(prompts, order, "prompt_idx")


def fast_forward_batches(prompts: DataFrame, ff: int, chunk: int, order: str = "ord") -> DataFrame:
    """batches of ``chunk`` prompts; batch b (1-based) runs when ``b*chunk >= ff``."""
    idx = _numbered(prompts, order)
    batch = F.ceil(F.col("prompt_idx") / chunk)
    return idx.withColumn("batch_idx", batch.cast("bigint")).filter(F.col("batch_idx") * chunk >= ff)


# ------------------------------------------------------------------- cache
def request_key(*cols: str) -> F.Column:
    """Stable content key of a request (sha256 over the fields joined by \\x01)."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)


def cached_completions(requests: DataFrame, cache: DataFrame, complete: Callable[[pd.DataFrame], pd.DataFrame],
                       key: str = "key", no_cache: bool = False) -> DataFrame:
    """J4+G3: hits come from the cache table, misses (or every request with
    ``no_cache``) go through ``complete`` in Arrow batches (``mapInPandas``);
    the result has a ``source`` column. ``complete`` gets a pandas frame with
    the request columns and returns it with a ``response`` column added."""
    req_cols = requests.columns
    if "finish_reason" not in cache.columns:
        cache = cache.withColumn("finish_reason", F.lit("stop"))
    stored = cache.select(key, "response", "finish_reason")
    if no_cache:
        hits = requests.limit(0).join(stored, key).withColumn("source", F.lit("hit"))
        misses = requests
    else:
        hits = requests.join(stored, key, "inner").withColumn("source", F.lit("hit"))
        misses = requests.join(cache.select(key), key, "left_anti")
    schema = (", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema.fields)
              + ", response string, finish_reason string")

    def run(batches):
        for pdf in batches:
            out = complete(pdf)
            if "finish_reason" not in out:
                out["finish_reason"] = "stop"
            yield out[[*req_cols, "response", "finish_reason"]]

    computed = misses.mapInPandas(run, schema).withColumn("source", F.lit("miss"))
    return hits.select(*req_cols, "response", "finish_reason", "source").unionByName(computed)


def shard_plan(prompts: DataFrame, n_workers: int, stride: int, start: int, order: str = "ord") -> DataFrame:
    """Worker i starts at ``stride*i + start`` (0-based prompt index) and
    runs to the end, so prompt k is processed by every worker whose start is
    at or before k. Emitted with a generator (bounded by ``n_workers``), not a
    join; A5 later keeps one result per prompt."""
    idx = ordinals.dense_index(prompts, order, "_rn").withColumn("prompt_idx", F.col("_rn") - 1).drop("_rn")
    covering = F.least(F.lit(n_workers), F.floor((F.col("prompt_idx") - start) / stride) + 1)
    return idx.filter(F.col("prompt_idx") >= start).withColumn(
        "worker", F.explode(F.sequence(F.lit(0).cast("bigint"), (covering - 1).cast("bigint"))))


def annotate(comparisons: DataFrame, judge: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Run a judge over ``(instruction, output_1, output_2)`` rows in Arrow
    batches; it returns 1 (first better), 2 (second better), 1.5 (tie) or
    null, stored as ``preference DOUBLE`` next to the input columns."""
    cols = comparisons.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in comparisons.schema.fields) + ", preference double"

    def run(batches):
        for pdf in batches:
            out = pdf.copy()
            out["preference"] = pd.to_numeric(judge(pdf), errors="coerce").astype("float64")
            yield out[[*cols, "preference"]]

    return comparisons.mapInPandas(run, schema)


def longer_output_judge(pdf: pd.DataFrame) -> pd.Series:
    """Deterministic stand-in judge: the longer output wins, equal length ties."""
    a, b = pdf["output_1"].fillna("").str.len(), pdf["output_2"].fillna("").str.len()
    return (a > b).map({True: 1.0, False: 2.0}).where(a != b, 1.5)


def valid_completions(df: DataFrame, response: str = "response", finish_reason: str | None = "finish_reason") -> DataFrame:
    """drop completions that did not finish with 'stop' and blank ones (an
    empty text is first mapped to a single space, which is then dropped)."""
    r = F.when(F.col(response) == "", F.lit(" ")).otherwise(F.col(response))
    cond = r != " "
    if finish_reason is not None:
        cond = cond & F.coalesce(F.col(finish_reason) == "stop", F.lit(False))
    return df.filter(cond)
