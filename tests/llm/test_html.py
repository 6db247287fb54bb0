"""HTML extraction: pages with a known article, awkward mark-up and awkward rows."""

import collections
import itertools

from catalune.llm.htmltext import extract, main_text

PAGES = {
    "<article><p title=it's>Hello world text.</p><p>That's all folks.</p></article>": "Hello world text. That's all folks.",
    "<article><p>One two <a href=x title=it's>three four</a> five six. Seven.</p></article>": "One two three four five six. Seven.",
    "<div title='a > b'>Text here.</div>": "Text here.",
    "<article><p>Begins here.</p><div class=ad>Buy this now.</div><p>Ends.</p></article><footer>f</footer>": "Begins here. Ends.",
    "<article><p>Post.</p><p class='legal'>The law says many things.</p><div class='related-work'><p>Earlier papers did the same.</p></div></article>": "Post. The law says many things. Earlier papers did the same.",
    "<article><p>Post.</p><div class='comments'><p>Nice post, I like it very much, more of this please. Really good.</p></div></article>": "Post.",
    "<article><p>Let <math><mi>x</mi></math> be.</p></article>": "Let x be.",
    "<p>a<b>c</p>": "ac",
    "<p>x &amp; y&nbsp;&#x41;": "x & y A",
}


def test_known_pages():
    assert {page: main_text(page) for page in PAGES} == PAGES


def test_composed_pages():
    """Every combination of frames around an article leaves the article."""
    article = "<h1>A title of it</h1><p>The first paragraph says this. It has two sentences.</p><ul><li>a point</li><li>another point</li></ul><p>The last one, with a <a href=/x>link</a> in it.</p>"
    want = "A title of it The first paragraph says this. It has two sentences. a point another point The last one, with a link in it."
    before = ["", "<nav><ul><li><a href=/a>One</a></li></ul></nav>", "<header><div class=logo>Site</div></header>", "<div class='cookie-notice'>We use cookies. Accept them all, please, as they are good.</div>"]
    after = ["", "<footer>&copy; Site. All rights reserved.</footer>", "<aside><p>You may also like this story of ours.</p></aside>", "<section id=comments><p>I liked this a lot. Thanks for it!</p></section>", "<form><label>Mail</label><input></form>", "<script>var a='</p>';</script>"]
    for a, b, holder in itertools.product(before, after, ("article", "main")):
        assert main_text(f"<html><body>{a}<{holder}>{article}</{holder}>{b}</body></html>") == want, (a, b, holder)


def test_awkward_rows(spark):
    kinds = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", "<p>a text of it</p>", "x", "y"), (1, "u", "<p>a text of it</p>", "x", "y"), (None, None, None, None, None), (2, "", "", "x", "y"), (3, "u", "<p>" + "long words here. " * 20000, "x", "y")]
    df = spark.createDataFrame(rows, kinds)
    got = collections.Counter((r.page_id, r.url, r.text, r.n_chars) for r in extract(df).collect())
    long = ("long words here. " * 20000).strip()
    assert got == collections.Counter([(1, "u", "a text of it", 12)] * 2 + [(None, None, "", 0), (2, "", "", 0), (3, "u", long, len(long))])
    assert extract(df.limit(0)).collect() == []
