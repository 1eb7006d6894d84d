import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from terminus.llm import html_text as h

ARTICLE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><a>Logo</a></header><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><header><h1>A &amp; B</h1></header><p>One
  <b>two</b>&nbsp;three<br>four<p>Five &lt;six&gt; caf&eacute; &#8364;<script>if (a</b) x("</p>")</script> seven
<div class="ad-box">Buy</div><ul><li>i<li>ii</ul><form><p>Mail</form><!-- no --><aside>Also</aside>
<pre>a   b</pre><table><tr><td>x<td>y</table><section id="comments"><article>Nice!</article></section></article></main>
<footer>&copy; all</footer></body></html>"""


def text_of(page):
    return h.decided(h.blocks(page))


def test_article_markup():
    assert text_of(ARTICLE).split("\n") == ["A & B", "One two three four", "Five <six> café € seven", "i", "ii", "a b", "x", "y"]


def test_odd_pages():
    for page in (None, "", " ", "<html><body></body></html>", "<nav>only</nav>", "<script>x", "<!-- open", "<p"):
        assert text_of(page) == ""
    assert text_of("<article>a < b & c &am") == "a < b & c &am"
    assert text_of("<article><p>x</p><footer>&copy; y") == "x"
    assert text_of("<ARTICLE><P CLASS='nav'>no</P><p title='a>b'>yes</ARTICLE>") == "yes"
    assert text_of("<article>" + "<b>" * 3000 + "deep" + "w " * 50_000) .startswith("deepw w")
    assert text_of("plain text") is None
    assert text_of("<article><p>" + "é" * 70_000) == "é" * 70_000


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=25), min_size=1, max_size=6), st.integers(1, 5))
def test_repeated_substrings_against_brute_force(streams, depth):
    if not any(streams):
        return
    mark, _, owner = h.repeated([np.array(s, np.uint64) for s in streams], depth)
    grams = [{tuple(s[i:i + depth]) for i in range(len(s) - depth + 1)} for s in streams]
    want = [len(s) - i >= depth and any(tuple(s[i:i + depth]) in g for k, g in enumerate(grams) if k != n)
            for n, s in enumerate(streams) for i in range(len(s))]
    assert mark.tolist() == want


def plain_pages(n):
    common = "share this page with your friends today and tomorrow please"
    return [(i, f"http://{'big' if i % 3 else 'x'}.org/{i}", f"<div>{common} now</div><div>story {i} " + " ".join(
        f"w{i}x{j}" for j in range(30)) + f"</div><p>all rights reserved by the owner of this site {i % 2}</p>") for i in range(n)]


def test_host_suffix_array_removes_what_repeats(spark):
    rows = plain_pages(40) + [(100, "http://alone.org/", plain_pages(1)[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for shard_tokens in (200_000, 90):  # one shard, and many shards of one host
        got = {r.page_id: r.text for r in h.extract(df, shard_tokens=shard_tokens).collect()}
        for i in range(40):
            assert got[i] == f"story {i} " + " ".join(f"w{i}x{j}" for j in range(30))
        assert got[100].count("\n") == 2  # nothing repeats on this host


def test_whole_table_and_edges(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in h.extract(pages).collect()}
    for p in pages.collect():
        assert got[p.page_id].text == text_of(p.html) and got[p.page_id].n_chars == len(text_of(p.html))
    rows = [(1, None, None), (2, "", ""), (None, "http://a/", "<article>x"), (3, "nonsense", "plain"), (3, "nonsense", "plain")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in h.extract(df).collect()) == [
        ("1", "", 0), ("2", "", 0), ("3", "plain", 5), ("3", "plain", 5), ("None", "x", 1)]
    assert h.extract(df.limit(0)).count() == 0


LONG = "<p>" + " ".join(f"word{i}" for i in range(40)) + "</p>"
WORDS = LONG[3:-4]


def test_articles_below_named_wrappers_and_forms():
    for around in ('<div class="layout has-sidebar">{}</div>', '<div id="banner-page">{}</div>', '<div class="no-comments">{}</div>',
                   '<form id="aspnetForm"><div>{}</div></form>', '<div class="page widget">{}</div>', '<div role="form">{}</div>',
                   '<form><div class="no-sidebar"><div>{}</div></div></form>'):
        for page in ("<article>{}</article>", "<main>{}</main>", '<div itemprop="articleBody">{}</div>'):
            assert text_of("<body><nav>Menu</nav>" + around.format(page.format(LONG)) + "<div class=ad>Buy</div></body>") == WORDS
    assert text_of(f'<article><div class="body-with-sidebar">{LONG}{LONG}</div><p>x</p></article>') == f"{WORDS}\n{WORDS}\nx"
    # Comments and teasers beside an article stay out, and what is hidden.
    for beside in ('<div id="comments"><article>' + LONG * 9 + "</article></div>", '<div class="related-posts"><article>Read</article></div>',
                   "<aside><article>No</article></aside>", '<div hidden class="x-ad"><article>No</article></div>', "<form>Mail</form>"):
        assert text_of(f"<article>{LONG}</article>{beside}") == WORDS


def test_containers_by_mass():
    assert text_of(f"<main>{LONG}{LONG}<article>Teaser</article></main>") == f"{WORDS}\n{WORDS}\nTeaser"
    assert text_of(f"<main>Share<article>{LONG}</article></main>") == WORDS
    assert text_of(f'<article>Teaser</article><div class="entry-content">{LONG}</div>') == f"Teaser\n{WORDS}"
    assert text_of(f"<article>Teaser</article><div>{LONG}</div>") is None


def test_pages_that_came_out_empty_reach_the_suffix_array(spark):
    common = "share this page with your friends today and tomorrow please"
    row = lambda i, a: (i, f"http://h.org/{i}", a.format(f"<p>{common} now</p><p>story {i} " + " ".join(f"w{i}x{j}" for j in range(30)) + "</p>"))
    kinds = ('<div class="no-comments">{}</div>', '<div class="widget">{}</div>', "<form>{}</form>",
             '<div class="has-sidebar">{}</div><p>Other plain text.</p>', "<article>Teaser</article><div>{}</div>")
    df = spark.createDataFrame([row(i, kinds[i % 5]) for i in range(20)], "page_id long, url string, html string")
    for r in h.extract(df).collect():
        story = f"story {r.page_id} " + " ".join(f"w{r.page_id}x{j}" for j in range(30))
        assert r.text == (story, story, story, f"{story}\nOther plain text.", f"Teaser\n{story}")[r.page_id % 5]


def test_every_page_goes_through_the_suffix_array(spark, monkeypatch):
    """Pages with article markup too: their menus are found to repeat, however many shards their host has."""
    menu = "one two three four five six seven eight nine ten"
    page = "<div>" + menu + "</div><article><p>{}</p></article>"
    rows = [(k, "http://h.example/" + str(k), page.format(f"text {k} " * 9)) for k in range(6)]
    kept = []
    monkeypatch.setattr(h, "written", lambda df, f=h.written: kept.append(f(df)) or kept[-1])
    for shard_tokens in (10_000, 10):
        kept.clear()
        got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), shard_tokens=shard_tokens).collect()}
        assert got == {k: f"text {k} " * 8 + f"text {k}" for k in range(6)}
        marked = next(df for df in kept if "mask" in df.columns)
        assert marked.count() == 6


def test_article_text_is_part_of_the_host_suffix_array(spark, monkeypatch):
    """A page's whole stream is looked up: what a page without markup shares with an
    article of its host repeats, whether both are in one shard or not."""
    quote = "these ten words stand in an article of this host"
    story = lambda i: " ".join(f"s{i}x{j}" for j in range(30))
    rows = [(i, f"http://h.example/{i}", f"<article><p>{story(i)}</p><p>{quote}</p></article>") for i in range(8)]
    rows += [(50 + i, f"http://h.example/{50 + i}", f"<div>{quote}</div><div>{story(50 + i)}</div>") for i in range(2)]
    rows += [(90, "http://other.example/", f"<div>{quote}</div><div>{story(90)}</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    kept = []
    monkeypatch.setattr(h, "written", lambda df, f=h.written: kept.append(f(df)) or kept[-1])
    for shard_tokens in (10_000, 10):
        kept.clear()
        got = {r.page_id: r.text for r in h.extract(df, shard_tokens=shard_tokens).collect()}
        assert all(got[i] == f"{story(i)}\n{quote}" for i in range(8))  # the markup keeps its article
        assert got[50] == story(50) and got[51] == story(51) and got[90] == f"{quote}\n{story(90)}"
        masks = {r.page_id: r.mask for r in next(x for x in kept if "mask" in x.columns).collect()}
        assert len(masks) == 11 and all(len(masks[i]) == 5 for i in range(8))  # 40 tokens of an article, a bit each
        if shard_tokens == 10_000:
            assert all(any(masks[i]) for i in range(8)) and not any(masks[90])


def test_copies_are_one_page_in_any_number_of_shards(spark):
    page = "<div>" + " ".join(f"w{j}" for j in range(20)) + "</div>"
    df = spark.createDataFrame([(i, f"http://h.example/{i}", page) for i in range(12)], "page_id long, url string, html string")
    for shard_tokens in (10_000, 20):
        assert {r.text for r in h.extract(df, shard_tokens=shard_tokens).collect()} == {page[5:-6]}
