"""Token-array scalars (K1-K9) as Column expressions.

The default tokenizer is native: whitespace-separated pieces mapped to ids by
md5, so it runs inside whole-stage codegen and is reproducible in SQL. A real
sub-word tokenizer plugs in through ``pandas_tokenizer`` (G1), an Arrow-batched
pandas UDF applied in a leaf projection.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed ids of the default tokenizer (padding uses the EOS id, as in the reference setup).
EOS_ID = 2
PAD_ID = EOS_ID
IGNORE = -100
FIRST_ID = 3
VOCAB = 50000


def _c(x):
    return F.col(x) if isinstance(x, str) else x


EOS_TEXT = "</s>"  # the EOS token's text; a text containing it tokenises to EOS


def pieces(s) -> Column:
    """Whitespace pieces of ``s`` (no empties); the EOS text is its own piece."""
    spaced = F.replace(F.coalesce(_c(s), F.lit("")), F.lit(EOS_TEXT), F.lit(f" {EOS_TEXT} "))
    return F.regexp_extract_all(spaced, F.lit(r"(\S+)"), 1)


_EOS_MARK = "\ue000"  # stands for the EOS text while a text is cut into pieces


def spans(s) -> Column:
    """The pieces of ``s`` with the white space before each, so that the first k of them
    are a slice of the text; as many as ``pieces`` has."""
    marked = F.replace(F.coalesce(_c(s), F.lit("")), F.lit(EOS_TEXT), F.lit(_EOS_MARK))
    return F.regexp_extract_all(marked, F.lit(rf"(\s*(?:{_EOS_MARK}|[^\s{_EOS_MARK}]+))"), 1)


def decode_first(s, k) -> Column:
    """K9: the text of the first ``k`` tokens of ``s``, white space as it was. EOS is a
    special token and leaves no text."""
    kept = F.array_join(F.slice(spans(s), 1, _c(k)), "")
    return F.replace(kept, F.lit(_EOS_MARK), F.lit(""))


def pandas_span_tokenizer(encode: Callable[[str], list[tuple[int, int]]]):
    """G1 with a way back: wrap a per-text ``encode`` that gives (id, end of the token
    in the text) per token. Returns (tokenize, decode_first) for one column each."""
    token = T.StructType([T.StructField("id", T.LongType()), T.StructField("end", T.IntegerType())])

    @F.pandas_udf(T.ArrayType(token))
    def tok(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: [{"id": int(i), "end": int(e)} for i, e in encode(t)])

    def first(s, k) -> Column:
        end = F.try_element_at(tok(_c(s)), F.greatest(_c(k), F.lit(1)).cast("int"))["end"]
        return F.when(_c(k) > 0, F.substring(_c(s), F.lit(1), F.coalesce(end, F.length(_c(s))))).otherwise(F.lit(""))

    return (lambda s: F.transform(tok(_c(s)), lambda t: t["id"])), first


def piece_id(p: Column) -> Column:
    h = F.conv(F.substring(F.md5(p), 1, 8), 16, 10).cast("bigint")
    return F.when(p == EOS_TEXT, F.lit(EOS_ID).cast("bigint")).otherwise(
        (F.lit(FIRST_ID) + F.pmod(h, F.lit(VOCAB - FIRST_ID))).cast("bigint"))


def default_tokenize(s) -> Column:
    """K1 (default): ARRAY<BIGINT> ids without special tokens."""
    return F.transform(pieces(s), piece_id)


def pandas_tokenizer(encode: Callable[[str], list[int]]):
    """G1: wrap a per-text ``encode`` (e.g. a HuggingFace tokenizer's
    ``encode(text, add_special_tokens=False)``) as an Arrow-batched pandas UDF."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def tok(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: [int(i) for i in encode(t)])

    return lambda s: tok(_c(s))


def with_eos(ids, eos: int = EOS_ID) -> Column:
    """Append EOS to a response (its mask position is 1)."""
    return F.concat(_c(ids), F.array(F.lit(eos).cast("bigint")))


def take_first(ids, n: int) -> Column:
    return F.slice(_c(ids), 1, n)


def take_last(ids, n: int) -> Column:
    """Python ``v[-n:]``: the last n (all when n exceeds the size; ``v[-0:]`` is all)."""
    a = _c(ids)
    if n == 0:
        return a
    return F.slice(a, F.greatest(F.size(a) - F.lit(n), F.lit(0)) + 1, n)


def ones_like(ids) -> Column:
    return F.array_repeat(F.lit(1).cast("bigint"), F.size(_c(ids)))


def label_mask(prompt_ids, response_ids) -> Column:
    """K4: prompt positions -100, response positions = ids."""
    return F.concat(F.array_repeat(F.lit(IGNORE).cast("bigint"), F.size(_c(prompt_ids))), _c(response_ids))


def pad_right(ids, length, value: int) -> Column:
    """K7 ``pad_to_length``: right pad to ``length``, never truncate."""
    a = _c(ids)
    n = F.greatest(_c(length) - F.size(a), F.lit(0)) if not isinstance(length, int) else F.greatest(F.lit(length) - F.size(a), F.lit(0))
    return F.concat(a, F.array_repeat(F.lit(value).cast("bigint"), n))


def pad_left(ids, length, value: int) -> Column:
    a = _c(ids)
    n = F.greatest(_c(length) - F.size(a), F.lit(0)) if not isinstance(length, int) else F.greatest(F.lit(length) - F.size(a), F.lit(0))
    return F.concat(F.array_repeat(F.lit(value).cast("bigint"), n), a)


def ids_text(ids) -> Column:
    """Array of ids as one space-separated string (for reports and oracles)."""
    return F.array_join(F.transform(_c(ids), lambda x: x.cast("string")), " ")
