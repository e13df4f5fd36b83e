"""T2 on hand-made fragments (the crawled pages have no pre/code blocks)."""

from __future__ import annotations

from prefspark.functions.html import _parsed, paragraph_text, strip_html


def test_top_level_paragraph_direct_text_only():
    assert paragraph_text("<p>Use <code>x</code> and <a href='#'>y</a> now</p>") == "Use  and  now"


def test_pre_code_blocks_and_top_level_code():
    html = "<p>a</p><pre><code>x = 1</code><code>y</code></pre><code>z&lt;1</code><div><p>nested</p></div>"
    assert paragraph_text(html) == "a\n\n<code>x = 1</code>\n\n<code>y</code>\n\n<code>z<1</code>"


def test_entities_comments_and_plain_text():
    assert paragraph_text("<p>&amp;b<!--c--></p>") == "&bc"
    assert paragraph_text("just text") == ""
    assert paragraph_text(None) is None


def test_unclosed_inline_tag_swallows_later_paragraphs():
    frag = "<h1>t</h1><p><b>bold<br><p>inner</p><p>more</p>"
    assert paragraph_text(frag) == ""  # the only top-level <p> has no direct text
    p = _parsed(frag)
    assert (p.n_top, p.n_top_p, p.n_chars) == (2, 1, len("tboldinnermore"))


def test_deep_and_unclosed_nesting():
    assert paragraph_text("<i>" * 5000 + "x") == ""
    assert paragraph_text("<pre><code>a<code>b</code></code>c</pre><code>d") == "<code>ab</code>\n\n<code>b</code>\n\n<code>d</code>"
    assert paragraph_text("<p>a<br>b</b></p></p><p>c") == "ab\n\nc"


def test_pandas_udf_matches_python(spark):
    frags = ["<p>one</p><p>two <em>x</em></p>", "<pre><code>a</code></pre>", "", "<p>unclosed <p>inner</p>"]
    df = spark.createDataFrame([(f,) for f in frags], ["h"])
    got = [r.t for r in df.select(strip_html("h").alias("t")).collect()]
    assert got == [paragraph_text(f) for f in frags]
