"""String scalars and row predicates as Column expressions (all JVM-side)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for equal results.
ASSISTANT_MARKER = "\n\nAssistant:"  # prompt/response boundary in transcripts
HUMAN_PREFIX = "Human: "  # single-turn template start
ASSISTANT_SUFFIX = "\n\nAssistant: "  # single-turn template end
SPECIAL_TOKENS_3 = ("<s>", "</s>", "<|endoftext|>")  # dialogue and annotation filters
SPECIAL_TOKENS_2 = ("<s>", "</s>")  # binarised-preference filter
MAX_WORDS = 2000  # length filter: drop at or above
MAX_CHARS = 8000
# Characters Python's str.split()/str.strip() treat as whitespace, as a regex
# class in \x{...} form (understood by Java regex and RE2 alike).
PY_WHITESPACE = (r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                 r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def transcript_prompt(s: str | Column) -> Column:
    """Prefix of ``s`` through the last ``\\n\\nAssistant:``; null when the
    marker is missing (callers route those rows to a reject table)."""
    s = _c(s)
    tail = F.substring_index(s, ASSISTANT_MARKER, -1)
    return F.when(F.instr(s, ASSISTANT_MARKER) > 0, s.substr(F.lit(1), F.length(s) - F.length(tail)))


def single_turn_prompt(instruction: str | Column) -> Column:
    """T3 (single-turn form): ``Human: x\\n\\nAssistant: ``."""
    return F.concat(F.lit(HUMAN_PREFIX), _c(instruction), F.lit(ASSISTANT_SUFFIX))


def dialogue_prompt(question: str | Column) -> Column:
    """T3 (transcript form): ``\\n\\nHuman: x\\n\\nAssistant:``."""
    return F.concat(F.lit("\n\nHuman: "), _c(question), F.lit(ASSISTANT_MARKER))


def strip_template(p: str | Column) -> Column:
    """T5: drop the 7 leading (``Human: ``) and 13 trailing (``\\n\\nAssistant: ``)
    characters, like ``p[len('Human: '):-len('\\n\\nAssistant: ')]``."""
    p = _c(p)
    n = F.greatest(F.length(p) - F.lit(len(HUMAN_PREFIX) + len(ASSISTANT_SUFFIX)), F.lit(0))
    return p.substr(F.lit(len(HUMAN_PREFIX) + 1), n)


def strip_ws(s: str | Column) -> Column:
    """Python ``str.strip()`` (all leading/trailing whitespace)."""
    return F.regexp_replace(_c(s), f"^{PY_WHITESPACE}+|{PY_WHITESPACE}+$", "")


def strip_spaces(s: str | Column) -> Column:
    """Python ``str.strip(' ')`` (spaces only) = Spark ``trim``."""
    return F.trim(_c(s))


def word_count(s: str | Column) -> Column:
    """``len(s.split())`` - whitespace runs, no empty words."""
    return F.size(F.filter(F.split(_c(s), f"{PY_WHITESPACE}+"), lambda w: w != F.lit("")))


def first_words(s: str | Column, n: int = 10) -> Column:
    """First ``n`` single-space words re-joined, plus a trailing space."""
    return F.concat(F.array_join(F.slice(F.split(_c(s), " "), 1, n), " "), F.lit(" "))


def rest_words(s: str | Column, n: int = 10) -> Column:
    """Words after the first ``n`` re-joined by single spaces."""
    words = F.split(_c(s), " ")
    return F.array_join(F.slice(words, n + 1, F.greatest(F.size(words) - n, F.lit(0))), " ")


def has_any(cols: Sequence[str | Column], tokens: Sequence[str]) -> Column:
    """True when any column contains any token (null text counts as no)."""
    cond = F.lit(False)
    for c in cols:
        for t in tokens:
            cond = cond | F.coalesce(F.instr(_c(c), t) > 0, F.lit(False))
    return cond


def too_long(s: str | Column, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS) -> Column:
    """words >= 2000 or characters >= 8000."""
    return (word_count(s) >= max_words) | (F.length(_c(s)) >= max_chars)


def response_after(decoded: str | Column, prompt: str | Column) -> Column:
    """Cut decoded text at the prompt's length and strip whitespace."""
    d = _c(decoded)
    return strip_ws(d.substr(F.length(_c(prompt)) + 1, F.greatest(F.length(d) - F.length(_c(prompt)), F.lit(0))))


def sample_path(path: str | Column) -> Column:
    """What a sample file's path says, as a struct: the prompt set, the
    maximum length, the temperature, and the offset of its first prompt (null for
    files that hold a whole evaluation set)."""
    p = _c(path)
    found = lambda pattern: F.nullif(F.regexp_extract(p, pattern, 1), F.lit(""))
    return F.struct(
        found(r"([A-Za-z0-9]+)[A-Za-z0-9_]*_maxlen\d+").alias("prompt_set"),
        found(r"_maxlen(\d+)").cast("bigint").alias("max_length"),
        found(r"_temp(\d+(?:\.\d+)?)").cast("double").alias("temperature"),
        found(r"fastforward(\d+)\.json").cast("bigint").alias("offset"),
    )


def run_model_name(key: str | Column) -> Column:
    """``key[len('llama7b_'):-3]``."""
    k = _c(key)
    return k.substr(F.lit(9), F.greatest(F.length(k) - F.lit(11), F.lit(0)))
