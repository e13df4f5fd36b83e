"""Preference-record sources (S1-S3, S7-S9, S12, S13) in long form.

The reference builds a dict ``prompt -> {responses, pairs, sft_target}``. Here
a dataset is two tables: pair rows D2 ``(prompt, pair_ix, chosen, rejected)``
and SFT rows D3 ``(prompt, sft_target, first_ord)``. Long form keeps every
group as rows, so nothing collects a whole prompt's answers into one array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.functions import text as T
from prefspark.operators import epochs, ordinals
from prefspark.sources.dialogue import last_wins, split_prompts


def score_ratio_ok(a: str = "score_a", b: str = "score_b", threshold: float = 2.0):
    """``max(a/b, b/a) >= 2``. A zero score (an error in Python) gives a null
    quotient that ``greatest`` skips, so 0-vs-x rows are dropped."""
    return F.coalesce(
        F.greatest(F.try_divide(F.col(a).cast("double"), F.col(b)), F.try_divide(F.col(b).cast("double"), F.col(a)))
        >= threshold,
        F.lit(False),
    )


def best_response(responses: DataFrame, group: list[str], text: str = "response", score: str = "score",
                  idx: str = "idx", out: str = "sft_target") -> DataFrame:
    """A3: arg-max response per group; a repeated text takes the score of its first
    occurrence and, on equal scores, the earliest response wins. Two partial
    aggregates (per text, then per group), so hot groups combine map-side."""
    per_text = responses.groupBy(*group, text).agg(
        F.min_by(F.col(score), F.col(idx)).alias("_eff"), F.min(idx).alias("_first")
    )
    return per_text.groupBy(*group).agg(
        F.max_by(F.col(text), F.struct(F.col("_eff"), -F.col("_first"))).alias(out)
    )


# ---------------------------------------------------------------- S1 scored Q&A
def se_split(answers: DataFrame, split: str, seed: int = 42, test_fraction: float = 0.01) -> DataFrame:
    """W3 for S1: rows (one per question row, ``q_ord``) ranked by a seeded md5
    key; the first ``int(test_fraction * n)`` are 'test', the rest 'train'
    (disjoint); any other split name keeps everything."""
    if split not in ("train", "test"):
        return answers
    rows = answers.select("q_ord").distinct()
    n = rows.count()
    k = int(n * test_fraction)
    keyed = rows.withColumn("_h", F.substring(F.md5(F.concat_ws("\u0001", F.lit(str(seed)),
                                                                F.col("q_ord").cast("string"))), 1, 15))
    ranked = ordinals.dense_index(keyed, ["_h", "q_ord"], out="_rn")
    chosen = ranked.filter((F.col("_rn") <= k) if split == "test" else (F.col("_rn") > k)).select("q_ord")
    return answers.join(chosen, "q_ord", "left_semi")


def se_clean(answers: DataFrame) -> DataFrame:
    """T2 on question and answer bodies (Arrow pandas UDF; after all filters)."""
    from prefspark.functions.html import strip_html

    return answers.withColumn("question", strip_html("question")).withColumn("answer", strip_html("answer"))


def se_latest(answers: DataFrame) -> DataFrame:
    """Rows of the last occurrence of every question (duplicate prompt: last replaces all)."""
    latest = answers.groupBy("question").agg(F.max("q_ord").alias("q_ord"))
    return answers.join(latest, ["question", "q_ord"], "left_semi")


def se_pair_tally(answers: DataFrame) -> DataFrame:
    """Every answer's standing in its question's i<j pair set, without
    emitting the pairs. In pair (i, j), i<j, the chosen one is i when
    ``score_i > score_j`` else j (a tie goes to the later answer), so

        wins_k   = #answers with a lower score + #earlier answers with an equal score
                 = (rank of k in (score, position) order) - 1
        losses_k = (n - 1) - wins_k

    The rank comes from ``index_within`` (a question holding a third of all
    answers is spread over many range partitions); n is a partial aggregate."""
    a = se_latest(answers).select(
        "question", "q_ord", "pos", F.concat(F.lit(" "), F.col("answer")).alias("response"),
        F.col("pm_score").alias("score"),
    )
    sizes = a.groupBy("question").agg(F.count(F.lit(1)).alias("_n"))
    ranked = ordinals.index_within(a, ["question"], ["score", "pos"], out="_r")
    return ranked.join(sizes, "question").select(
        T.dialogue_prompt("question").alias("prompt"),
        "pos", "response", "score",
        (F.col("_r") - 1).cast("bigint").alias("wins"),
        (F.col("_n") - F.col("_r")).cast("bigint").alias("losses"),
    )


class ScoredPairs:
    """The i<j answer pairs of every question as a space of positions.

    ``groups`` has one row per question of two answers or more: first_ord (its row)
    and n_pairs = n(n-1)/2. ``rows`` turns positions into pairs: the triangular root
    gives the two answers' places, and only the questions asked for have their answers numbered
    and read. In pair (i, j) the chosen one is i when ``score_i > score_j``, else j."""

    def __init__(self, answers: DataFrame):
        self._answers = se_latest(answers).withColumnRenamed("q_ord", "first_ord")

    @property
    def groups(self) -> DataFrame:
        n = F.count(F.lit(1))
        sizes = self._answers.groupBy("first_ord").agg(n.alias("n"))
        return sizes.where("n > 1").select("first_ord", F.expr("n * (n - 1) div 2").alias("n_pairs"), "n")

    def rows(self, drawn: DataFrame) -> DataFrame:
        """``drawn`` (first_ord, pair, n, ...) with prompt, chosen_ix, rejected_ix, chosen, rejected."""
        i, j = epochs.unrank(F.col("pair"), F.col("n"))
        asked = drawn.withColumn("_i", i).withColumn("_j", j)
        wanted = self._answers.join(drawn.select("first_ord").distinct(), "first_ord", "left_semi")
        placed = ordinals.index_within(wanted, ["first_ord"], "pos", out="_k").select(
            "first_ord", (F.col("_k") - 1).alias("_k"), "question", F.concat(F.lit(" "), F.col("answer")).alias("text"), F.col("pm_score").alias("score"))
        side = lambda k: placed.select(F.col("first_ord").alias(f"_f{k}"), F.col("_k").alias(f"_k{k}"), *[F.col(c).alias(f"_{c}{k}") for c in ("question", "text", "score")])
        both = asked.join(side("i"), (F.col("first_ord") == F.col("_fi")) & (F.col("_i") == F.col("_ki")))
        both = both.join(side("j"), (F.col("first_ord") == F.col("_fj")) & (F.col("_j") == F.col("_kj")))
        first = F.coalesce(F.col("_scorei") > F.col("_scorej"), F.lit(False))
        pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
        return both.select(
            *drawn.columns, T.dialogue_prompt("_questioni").alias("prompt"),
            pick("_i", "_j").alias("chosen_ix"), pick("_j", "_i").alias("rejected_ix"),
            pick("_texti", "_textj").alias("chosen"), pick("_textj", "_texti").alias("rejected"),
        )


class ListedPairs:
    """Pairs that exist as rows, in the same form as ``ScoredPairs``. Pair k of a
    prompt uses the responses (2k, 2k + 1); which of them is chosen is not known here."""

    def __init__(self, pairs: DataFrame):
        self._pairs = pairs

    @property
    def groups(self) -> DataFrame:
        return self._pairs.groupBy("first_ord").agg(F.count(F.lit(1)).alias("n_pairs")).withColumn("n", 2 * F.col("n_pairs"))

    def rows(self, drawn: DataFrame) -> DataFrame:
        mine = self._pairs.select(F.col("first_ord").alias("_f"), F.col("pair_ix").alias("_p"), "prompt", "chosen", "rejected")
        both = drawn.join(mine, (F.col("first_ord") == F.col("_f")) & (F.col("pair") == F.col("_p")))
        none = F.lit(None).cast("bigint")
        return both.select(*drawn.columns, "prompt", none.alias("chosen_ix"), none.alias("rejected_ix"), "chosen", "rejected")


def se_sft_target(answers: DataFrame) -> DataFrame:
    """S1 sft_target: best answer of the last occurrence of every question."""
    a = se_latest(answers).select(
        "question", "q_ord", F.col("pos").alias("idx"),
        F.concat(F.lit(" "), F.col("answer")).alias("response"), F.col("pm_score").alias("score"),
    )
    best = best_response(a, ["question", "q_ord"])
    return best.select(T.dialogue_prompt("question").alias("prompt"), "sft_target", F.col("q_ord").alias("first_ord"))


# ------------------------------------------------------- S2 two-answer prefs
def shp_pairs(shp: DataFrame) -> DataFrame:
    """Rows passing F4 appended per prompt; pair k uses indices (2k, 2k+1),
    A chosen when ``labels == 1``."""
    kept = shp.filter(score_ratio_ok()).withColumn("prompt", T.dialogue_prompt("history"))
    ranked = ordinals.index_within(kept, ["prompt"], "ord", out="_k")
    a_wins = F.col("labels") == 1
    return ranked.select(
        "prompt",
        (F.col("_k") - 1).alias("pair_ix"),
        F.when(a_wins, 2 * (F.col("_k") - 1)).otherwise(2 * (F.col("_k") - 1) + 1).alias("chosen_ix"),
        F.when(a_wins, 2 * (F.col("_k") - 1) + 1).otherwise(2 * (F.col("_k") - 1)).alias("rejected_ix"),
        F.when(a_wins, F.concat(F.lit(" "), "human_ref_a")).otherwise(F.concat(F.lit(" "), "human_ref_b")).alias("chosen"),
        F.when(a_wins, F.concat(F.lit(" "), "human_ref_b")).otherwise(F.concat(F.lit(" "), "human_ref_a")).alias("rejected"),
        "ord", "human_ref_a", "human_ref_b", "score_a", "score_b",
    )


def shp_sft_target(shp: DataFrame) -> DataFrame:
    """S2 sft_target: highest-scoring response over the prompt's accumulated list."""
    p = shp_pairs(shp)
    responses = p.select(
        "prompt", "ord",
        F.explode(F.array(
            F.struct((2 * F.col("pair_ix")).alias("idx"), F.concat(F.lit(" "), "human_ref_a").alias("response"),
                     F.col("score_a").alias("score")),
            F.struct((2 * F.col("pair_ix") + 1).alias("idx"), F.concat(F.lit(" "), "human_ref_b").alias("response"),
                     F.col("score_b").alias("score")),
        )).alias("r"),
    ).select("prompt", "ord", "r.*")
    best = best_response(responses, ["prompt"])
    first = p.groupBy("prompt").agg(F.min("ord").alias("first_ord"))
    return best.join(first, "prompt")


# ------------------------------------------------------- S3 transcripts
def hh_rows(hh: DataFrame) -> DataFrame:
    """S3 per row: prompt through the last assistant marker of *chosen*; both
    responses cut at that length. Rows without the marker are dropped (the
    reference asserts); see ``hh_rejects``."""
    p = T.transcript_prompt("chosen")
    return hh.withColumn("prompt", p).filter(F.col("prompt").isNotNull()).select(
        "ord", "prompt",
        F.expr("substring(chosen, length(prompt) + 1)").alias("chosen"),
        F.expr("substring(rejected, length(prompt) + 1)").alias("rejected"),
    )


def hh_rejects(hh: DataFrame) -> DataFrame:
    return hh.filter(T.transcript_prompt("chosen").isNull())


def hh_pairs(hh: DataFrame) -> DataFrame:
    rows = hh_rows(hh)
    ranked = ordinals.index_within(rows, ["prompt"], "ord", out="_k")
    return ranked.select(
        "prompt", (F.col("_k") - 1).alias("pair_ix"),
        (2 * (F.col("_k") - 1)).alias("chosen_ix"), (2 * (F.col("_k") - 1) + 1).alias("rejected_ix"),
        "chosen", "rejected", "ord",
    )


def hh_sft_target(hh: DataFrame) -> DataFrame:
    """S3 sft_target: chosen response of the prompt's last row."""
    return last_wins(hh_rows(hh), value="chosen")


# ------------------------------------------------------- S7 annotations
def aiprefs(ann: DataFrame, split: str = "train", data_fraction: float = 1.0, test_n: int = 512) -> DataFrame:
    """Prefix fraction, then 3-token filter, then one pair per prompt: (0,1)
    iff ``preference == 1`` (null and ties give (1,0)); sft_target = output_1;
    last row wins."""
    ann = ordinals.prefix_fraction(ann, "ord", data_fraction)
    kept = ann.filter(~T.has_any(["instruction", "output_1", "output_2"], T.SPECIAL_TOKENS_3))
    first_wins = F.coalesce(F.col("preference") == 1, F.lit(False))
    rows = kept.select(
        T.single_turn_prompt("instruction").alias("prompt"), "ord",
        F.struct(
            F.when(first_wins, F.col("output_1")).otherwise(F.col("output_2")).alias("chosen"),
            F.when(first_wins, F.col("output_2")).otherwise(F.col("output_1")).alias("rejected"),
            F.col("output_1").alias("sft_target"),
        ).alias("v"),
    )
    rec = last_wins(rows, value="v", value_out="v").select("prompt", "first_ord", "v.*")
    return split_prompts(rec, split, test_n)


# ------------------------------------------------------- S8/S9 binarised
def binarized(pref: DataFrame, split: str = "train", test_n: int = 256) -> DataFrame:
    """2-token filter; responses cut at ``len('Human: ' + prompt + '\\n\\nAssistant: ')``;
    pair (0,1); sft_target = chosen; last wins; test = first 256."""
    kept = pref.filter(~T.has_any(["prompt", "chosen", "rejected"], T.SPECIAL_TOKENS_2))
    tmpl = T.single_turn_prompt("prompt")
    rows = kept.select(
        tmpl.alias("prompt"), "ord",
        F.struct(
            F.expr("substring(chosen, length('Human: ' || prompt || '\n\nAssistant: ') + 1)").alias("chosen"),
            F.expr("substring(rejected, length('Human: ' || prompt || '\n\nAssistant: ') + 1)").alias("rejected"),
        ).alias("v"),
    )
    rec = last_wins(rows, value="v", value_out="v").select(
        "prompt", "first_ord", F.col("v.chosen").alias("chosen"), F.col("v.rejected").alias("rejected"),
        F.col("v.chosen").alias("sft_target"),
    )
    return split_prompts(rec, split, test_n)


def binarized_narrow(pref: DataFrame, split: str, train_source: str = "narrow", eval_source: str = "wide") -> DataFrame:
    """Train reads one source, every other split the shared evaluation source."""
    src = train_source if split == "train" else eval_source
    return binarized(pref.filter(F.col("source") == src), split)


# ------------------------------------------------------- S12 plain text
def wikitext(docs: DataFrame, split: str = "test", fixed_ord: int | None = None, min_len: int = 100,
             train_n: int = 10, test_n: int | None = 128, text: str = "text", order: str = "doc_id") -> DataFrame:
    """Texts longer than ``min_len`` become (first 10 words + ' ', rest);
    scanning in order stops once ``N`` distinct prompts exist, and a prompt keeps
    the last completion written before the stop. Train starts with one fixed
    entry under prompt ''. The stop point is found from the first N distinct
    prompts only (a bounded top-N), then the prefix is aggregated in parallel.
    ``test_n=None`` asks for all prompts: no top-N and no stop."""
    cand = docs.filter(F.length(text) > min_len).select(
        F.col(order).cast("bigint").alias("ord"),
        T.first_words(text).alias("prompt"), T.rest_words(text).alias("target"),
    )
    n = train_n - 1 if split == "train" else test_n
    scanned = cand
    if n is not None:
        firsts = cand.groupBy("prompt").agg(F.min("ord").alias("first_ord"))
        top = ordinals.first_n(firsts, "first_ord", n)
        found, stop = top.agg(F.count("*"), F.max("first_ord")).first()
        if found == n:  # with fewer than N prompts the scan runs to the end of the texts
            scanned = cand.filter(F.col("ord") <= F.lit(stop))
    rec = last_wins(scanned)
    if split == "train":
        fixed = docs.filter(F.col(order) == F.lit(fixed_ord)).select(
            F.lit("").alias("prompt"), F.col(text).alias("sft_target"), F.lit(-1).cast("bigint").alias("first_ord")
        )
        rec = fixed.unionByName(rec)
    return rec


# ------------------------------------------------------- S5/S6 completion maps
def completion_map_sft(maps: DataFrame, split: str = "train", data_fraction: float = 1.0,
                       test_n: int = 256) -> DataFrame:
    """S5/S6 over ``io.read_completion_maps`` rows ``(file, pos, prompt,
    completions)``: entries are concatenated in (sorted file path, position)
    order (U2), the first ``int(n * data_fraction)`` kept (W1), each becomes
    prompt ``Human: <key>\\n\\nAssistant: `` with the first completion as
    target (W11); a repeated prompt keeps its first position and the last
    value; 'test' is the first ``test_n`` prompts (256 for S5, 512 for S6)."""
    ordered = ordinals.dense_index(maps, ["file", "pos"], out="ord")
    ordered = ordinals.prefix_fraction(ordered, "ord", data_fraction)
    rows = ordered.select(T.single_turn_prompt("prompt").alias("prompt"),
                          F.element_at("completions", 1).alias("target"), "ord")
    return split_prompts(last_wins(rows), split, test_n)


# ------------------------------------------------------- S13 evaluation set
def alpaca_prompts(bench: DataFrame, instruction: str = "text", output: str | None = None,
                   order: str = "item_id") -> DataFrame:
    """Prompt from the instruction; the reference output (if any) is kept as
    ``sft_target`` (marked do-not-use); split ignored; last wins."""
    out = F.col(output) if output else F.lit(None).cast("string")
    rows = bench.select(T.single_turn_prompt(instruction).alias("prompt"), out.alias("target"),
                        F.col(order).cast("bigint").alias("ord"))
    return last_wins(rows)
