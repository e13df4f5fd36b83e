"""Keep the text of top-level paragraphs and code blocks of an HTML
fragment (scored Q&A bodies), drop everything else.

Only top-level elements count:
  * ``<p>``   -> its *direct* text children joined (inline ``<a>``, ``<em>``,
                 inline ``<code>`` ... inside it are dropped);
  * ``<pre>`` -> every ``<code>`` inside it, as ``<code>text</code>``;
  * ``<code>``-> ``<code>text</code>``;
results are joined with a blank line. Matching open and close tags is
beyond SQL string functions, so this runs as an Arrow-batched pandas UDF over the
events of the stdlib HTML tokenizer: one pass per row, no state across rows.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that never hold children (the tokenizer reports no end tag for them).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Paragraphs(HTMLParser):
    """Collects the wanted text while the fragment streams by: the open tags, the
    parts found so far, and which of them still take text. No tree is kept, so the
    depth of a fragment costs nothing but its open tags' names."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.parts: list[list[str]] = []
        #: (depth at which it was opened, part) of the code elements that are open.
        self.codes: list[tuple[int, list[str]]] = []
        self.n_top = self.n_top_p = self.n_chars = 0

    def handle_starttag(self, tag, attrs):
        self._begin(tag)
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self._begin(tag)
        self._forget()

    def _begin(self, tag):
        depth = len(self.open)
        if depth == 0:
            self.n_top += 1
            self.n_top_p += tag == "p"
        if tag == "code" and (depth == 0 or self.open[0] == "pre"):
            part = ["<code>"]
            self.parts.append(part)
            self.codes.append((depth, part))
        elif tag == "p" and depth == 0:
            self.parts.append([])

    def _forget(self):
        while self.codes and self.codes[-1][0] >= len(self.open):
            self.codes.pop()[1].append("</code>")

    def handle_endtag(self, tag):
        if tag in self.open:  # closes everything opened since
            while self.open.pop() != tag:
                pass
            self._forget()

    def handle_data(self, data):
        self.n_chars += len(data)
        self._text(data)
        for _, part in self.codes:
            part.append(data)

    def handle_comment(self, data):
        self._text(data)

    def _text(self, data):
        if self.open == ["p"]:
            self.parts[-1].append(data)

    def close(self):
        super().close()
        self.open.clear()
        self._forget()


def _parsed(fragment: str) -> _Paragraphs:
    p = _Paragraphs()
    p.feed(fragment)
    p.close()
    return p


def paragraph_text(fragment: str | None) -> str | None:
    """T2 of one fragment."""
    return None if fragment is None else "\n\n".join(map("".join, _parsed(fragment).parts))


@F.pandas_udf(T.StringType())
def _strip_udf(html: pd.Series) -> pd.Series:
    return html.map(paragraph_text)


_REPORT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_top", T.LongType()),
                        T.StructField("n_top_p", T.LongType()), T.StructField("n_text_chars", T.LongType())])


@F.pandas_udf(_REPORT)
def _report_udf(html: pd.Series) -> pd.DataFrame:
    rows = []
    for h in html:
        p = None if h is None else _parsed(h)
        rows.append((None,) * 4 if p is None else ("\n\n".join(map("".join, p.parts)), p.n_top, p.n_top_p, p.n_chars))
    return pd.DataFrame(rows, columns=[f.name for f in _REPORT.fields])


def html_report(col: str | Column) -> Column:
    """T2's text and what it had to work with, in one parse: top-level elements,
    top-level paragraphs, characters of all text (an unclosed inline tag can
    swallow every later paragraph, leaving nothing at top level)."""
    return _report_udf(F.col(col) if isinstance(col, str) else col)


def strip_html(col: str | Column) -> Column:
    """Column form of T2 (Arrow batches, vectorised transfer; keep it after filters)."""
    return _strip_udf(F.col(col) if isinstance(col, str) else col)
