"""T2 over the crawled pages and over fragments built from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.functions import html
from prefspark.plans.registry import register
from prefspark.sources.fixtures import table


@register("html_paragraphs", "T2 G2")
def html_paragraphs(spark, sf_dir):
    """T2 over whole pages (rows only: the rule needs the tags matched)."""
    pages = table(spark, sf_dir, "pages").select("page_id", html.html_report("html").alias("r"))
    return pages.select("page_id", "r.text", F.length("r.text").cast("bigint").alias("n_chars"), "r.n_top", "r.n_top_p", "r.n_text_chars")


_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@register("html_fragments", "T2 S1", sql="""
    select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda line, i:
             case when i % 3 = 0 then '<code>' || line || '</code>' else line || ' and ' end), chr(10) || chr(10)) as text
    from documents""")
def html_fragments(spark, sf_dir):
    """T2 over well-formed fragments that hold every document's lines: two
    paragraphs with an inline element, then a code block, nested and with text
    outside that T2 must drop."""
    wrapped = F.transform(F.split("text", "\n"), lambda x, i: F.when(
        i % 3 == 2, F.concat(F.lit("<pre>shell <b><code>"), x, F.lit("</code></b></pre>dropped"))
    ).otherwise(F.concat(F.lit("<p>"), x, F.lit(" and <em>more</em></p><div><p>inner</p></div>"))))
    escaped = F.expr(_ESCAPED.format("text")).alias("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", escaped)
    return docs.select("doc_id", html.strip_html(F.array_join(wrapped, "\n")).alias("text"))
