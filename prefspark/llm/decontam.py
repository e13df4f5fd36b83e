"""Operator 8, benchmark decontamination: a generalised suffix automaton of the
normalised benchmark items, through which every document's tokens are streamed.

Normal form: A-Z lower-cased, words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
A window is ``window`` consecutive words of an item; an item of fewer words (but
not none) is one window. While a document streams through the automaton, the
longest match that ends at each word is tracked; a match of at least ``window``
words covers all its words, and a short item covers its own.

The benchmark is taken in blocks of at most ``block_bytes`` (counted before a
block is collected), each block with an automaton of its own; a window lies in
one item, so blocks lose nothing. ``clean`` cuts and judges on what all blocks
found in the same text. Documents are never shuffled.

Defined results: a null or empty text has no words and no hits; items without
words or without text match nothing; an item with a null id counts for the hits only; repeated items are separate items (each
id counts once); repeated document rows are answered row by row; an empty
benchmark or document table gives zero hits or no rows. Columns besides the id
and the text are ignored by ``scan`` and carried unchanged by ``clean``.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from prefspark.llm.common import free_name, prepare, saved, table, texts_of

WINDOW = 10
#: A document with a larger share of its words covered is dropped by ``clean``.
MAX_COVERAGE = 0.5
#: Text of the items in one automaton; a block's states stay near 100 MB.
BLOCK_BYTES = 1 << 20

_WORD = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class Automaton:
    """Suffix automaton over the word ids of several items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        tokens = []
        for item, text in items:
            words = words_of(text)
            if words:
                tokens.append((item, [self.ids.setdefault(w, len(self.ids)) for w in words]))
                last = 0
                for w in tokens[-1][1]:
                    last = self._add(last, w)
        n = len(self.next)
        order = sorted(range(1, n), key=self.length.__getitem__)
        #: The state that holds the last ``window`` words of a match that ends in a state.
        self.at_window = [0] * n
        for s in order:
            above = self.link[s]
            if self.length[s] >= window:
                self.at_window[s] = s if self.length[above] < window else self.at_window[above]
        self.items: dict[int, set[str]] = {}
        whole: dict[int, list[tuple[int, str]]] = {}
        for item, ws in tokens:
            s = 0
            for k, w in enumerate(ws):
                s = self.next[s][w]
                if k + 1 >= window:
                    self.items.setdefault(self.at_window[s], set()).add(item)
            if len(ws) < window:
                whole.setdefault(s, []).append((len(ws), item))
        #: Short items that end where a match ends in a state.
        self.short: dict[int, list[tuple[int, str]]] = {}
        if whole:
            for s in order:
                own = whole.get(s, []) + self.short.get(self.link[s], [])
                if own:
                    self.short[s] = own
        self.least = min([window, *(len(ws) for _, ws in tokens)]) if tokens else 0

    def _add(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(w)
        if q is not None:
            if length[q] == length[last] + 1:
                return q
            return self._split(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        twin = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = twin
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = twin
            p = link[p]
        return twin

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Covered word spans (merged, end exclusive), the items with a window in
        ``words``, and the longest match."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        longest = 0
        if len(words) < self.least or not self.least:
            return spans, found, longest
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        known = np.zeros(len(ids) + 2, np.int8)
        known[1:-1] = ids >= 0
        edge = np.flatnonzero(np.diff(known))
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a < self.least:  # no window fits into these known words
                continue
            s = n = 0
            for p, w in enumerate(ids[a:b].tolist(), a):
                while s and w not in nxt[s]:
                    s = link[s]
                    n = length[s]
                s = nxt[s].get(w, 0)
                n = n + 1 if s else 0
                longest = max(longest, n)
                cover = 0
                if n >= window:
                    cover = n
                    found |= self.items[self.at_window[s]]
                for size, item in self.short.get(s, ()):
                    if size <= n:
                        cover = max(cover, size)
                        found.add(item)
                if cover:
                    first = p + 1 - cover
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, p + 1))
        return spans, found, longest


class Blocks:
    """The benchmark as lists of (item id, text), each of a bounded size: the sum of the
    lengths sets the number of blocks, a hash deals the items out. With several blocks
    the items are saved once, sorted by block, so that each block's read skips the
    others. One block at a time is on the driver and broadcast; it is released when
    the next one is asked for. Items with a null id are kept: their windows are hits."""

    def __init__(self, benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
        items = benchmark.select(
            F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")
        ).where("text is not null")
        total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.n = max(1, -(-2 * total // block_bytes))  # half full on average, so that uneven blocks fit
        if self.n > 1:
            block = F.pmod(F.xxhash64("item", "text"), F.lit(self.n))
            items = saved(items.withColumn("block", block).sort("block"))
        self._items, self._open = items, None

    def __getitem__(self, k: int):
        if self._open is not None:
            self._open.unpersist()
        rows = self._items.where(F.col("block") == k) if self.n > 1 else self._items
        block = [(r.item, r.text.encode()) for r in rows.select("item", "text").toLocalIterator()]
        self._open = self._items.sparkSession.sparkContext.broadcast(block)
        return self._open


def _merged(spans):
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_FOUND = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>, longest bigint"
_FOUND_ARROW = [
    ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("items", pa.list_(pa.string())),
    ("longest", pa.int64()),
]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document row: id, n_words, the covered word spans (merged, end
    exclusive), the items with occurring windows (sorted as strings) and the
    longest match in words."""
    spark = docs.sparkSession
    prepare(spark)
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = out.schema["doc_id"].dataType
    blocks = Blocks(benchmark, item_col, item_text, block_bytes)
    for k in range(blocks.n):
        before = saved(out) if k else out  # ends the use of the block before
        out = _scan_block(before, blocks[k], window, keep_text=k + 1 < blocks.n, id_type=id_type)
    return out


def _scan_block(docs: DataFrame, block, window: int, keep_text: bool, id_type) -> DataFrame:
    again = "spans" in docs.columns

    def run(batches):
        auto = Automaton(block.value, window)
        for b in batches:
            had = b.column("spans").to_pylist() if again else repeat([])
            had_items = b.column("items").to_pylist() if again else repeat([])
            had_longest = b.column("longest").to_pylist() if again else repeat(0)
            cols: list[list] = [[], [], [], []]
            for text, s0, i0, l0 in zip(texts_of(b.column("text")), had, had_items, had_longest):
                words = words_of(text)
                spans, items, longest = auto.scan(words)
                cols[0].append(len(words))
                cols[1].append([{"start": x, "end": y} for x, y in _merged([*spans, *((s["start"], s["end"]) for s in s0)])])
                cols[2].append(sorted(items.union(i0) - {None}))
                cols[3].append(max(longest, l0))
            arrays = [pa.array(c, t) for c, (_, t) in zip(cols, _FOUND_ARROW)]
            kept = ["doc_id", *["text"] * keep_text]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *arrays], [*kept, *(n for n, _ in _FOUND_ARROW)])

    return docs.mapInArrow(run, f"doc_id {id_type.simpleString()}, {'text string, ' * keep_text}{_FOUND}")


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the word spans; each cut leaves a line break."""
    normal = text.translate(_WORD)
    words = normal.split()
    starts, at = [], 0
    for w in words:
        at = normal.index(w, at)
        starts.append(at)
        at += len(w)
    out, done = [], 0
    for a, b in spans:
        out += [text[done : starts[a]], b"\n"]
        done = starts[b - 1] + len(words[b - 1])
    return b"".join([*out, text[done:]])


_SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def _clean_round(docs: DataFrame, text_col: str, spans_col: str, blocks: Blocks, window: int, max_coverage: float) -> DataFrame:
    """``docs`` with the spans that any of the blocks covers cut out of the texts,
    and with the spans in ``spans_col``; without documents of which more than
    ``max_coverage`` is covered. Every block scans the same text, so neither the
    coverage nor the cuts depend on the number of blocks."""
    at, names = docs.columns.index(text_col), [*docs.columns, spans_col]
    schema = StructType([*docs.schema, StructField(spans_col, _SPANS)])
    out = docs
    for k in range(blocks.n):
        block = blocks[k]

        def run(batches, block=block, again=k > 0, last=k + 1 == blocks.n):
            auto = Automaton(block.value, window)
            for b in batches:
                columns = b.columns
                had = columns.pop().to_pylist() if again else repeat([])
                null = columns[at].is_null().to_pylist()
                new, spans, keep = [], [], []
                for text, n, s0 in zip(texts_of(columns[at]), null, had):
                    words = words_of(text)
                    found = _merged([*auto.scan(words)[0], *((s["start"], s["end"]) for s in s0)])
                    if last:
                        keep.append(sum(y - x for x, y in found) <= max_coverage * len(words))
                        text = _cut(text, found) if found and keep[-1] else text
                    new.append(None if n else text.decode("utf-8", "surrogatepass"))
                    spans.append([{"start": x, "end": y} for x, y in found])
                columns[at] = pa.array(new, pa.string())
                whole = pa.RecordBatch.from_arrays([*columns, pa.array(spans, _FOUND_ARROW[1][1])], names)
                yield whole.filter(pa.array(keep)) if last else whole

        out = saved(out.mapInArrow(run, schema))
    return out


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_coverage: float = MAX_COVERAGE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with the covered spans removed from the text and without documents
    of which more than ``max_coverage`` is covered; all columns and their order
    stay, rows without a hit are unchanged (null texts stay null). What was apart
    may meet after a cut, so texts that were cut are scanned again by all blocks
    until none is; the coverage is judged once, on the text as it came."""
    spark = docs.sparkSession
    prepare(spark)
    spans = free_name(docs.columns, "spans")
    blocks = Blocks(benchmark, item_col, item_text, block_bytes)
    settled, left = None, docs
    while True:
        left = _clean_round(left, text_col, spans, blocks, window, max_coverage)
        done = left.where(F.size(spans) == 0).drop(spans)
        settled = done if settled is None else settled.union(done)
        left = left.where(F.size(spans) > 0).drop(spans)
        if left.isEmpty():
            return settled
        max_coverage = 1.0


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items; the digest of the items."""
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def brute_force(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> dict:
    """The contract, window by window; for tests."""
    words = words_of((text or "").encode())
    hit, found = set(), set()
    for item, body in items:
        iw = words_of((body or "").encode())
        size = min(window, len(iw))
        wins = {tuple(iw[k : k + size]) for k in range(len(iw) - size + 1)} if size else set()
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in wins:
                found.add(item)
                hit.update(range(k, k + size))
    return {
        "n_words": len(words),
        "n_hit": len(hit),
        "n_items": len(found),
        "items_sha256": hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
        "contaminated": bool(hit),
    }
