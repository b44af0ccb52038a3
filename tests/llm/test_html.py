"""Extraction from pages with planted boilerplate."""

from seqlytics.llm import html

PAGE = """<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header class="site"><a href="/">Site name</a></header><nav><ul><li><a href="/a">n{i}</a></li><li><a>x</a></li></ul></nav>
<div class="cookie-notice">We use cookies {i}</div><aside>More {i}</aside>
<article><h1>Title &amp; {i}</h1><p>First&nbsp;para {i}<br>two <b>bold</b>ly
 spread<p>Second {i}</p><form><input>Name {i}</form><p>Share this</p></article>
<div id="comments"><p>Comment {i}</p></div><footer>&copy; {i}</footer></body></html>"""


def extracted(spark, rows, schema="page_id long, url string, html string"):
    return {r["key"]: (r["text"], r["n_chars"]) for r in html.extract(spark.createDataFrame(rows, schema)).collect()}


def test_article_without_boilerplate(spark):
    got = extracted(spark, [(i, f"http://a.org/{i}", PAGE.format(i=i)) for i in range(12)])
    for i in range(12):
        text = f"Title & {i} First para {i} two boldly spread Second {i}"  # what never changes and names itself is template, in the article too
        assert got[i] == (text, len(text))


def test_constant_blocks_are_template(spark):
    page = "<body><div class=top><p>Welcome to us</p></div><div class=text><p>Own words {i}</p></div></body>"
    got = extracted(spark, [(i, "http://b.org/", page.format(i=i)) for i in range(5)])
    assert {t for t, _ in got.values()} == {f"Own words {i}" for i in range(5)}


def test_page_without_article_drops_link_lists(spark):
    page = "<div class=x><a href=1>Home {i}</a> <a href=2>About {i}</a></div><div class=y>Real words {i}, more of them</div>"
    got = extracted(spark, [(i, "http://c.org/", page.format(i=i)) for i in range(4)])
    assert got[2][0] == "Real words 2, more of them"


def test_copies_of_one_article_stay(spark):
    page = "<body><nav>menu {i}</nav><article><p>The same article everywhere</p></article></body>"
    got = extracted(spark, [(i, "http://d.org/", page.format(i=i)) for i in range(6)])
    assert {t for t, _ in got.values()} == {"The same article everywhere"}


def test_what_repeats_in_articles_stays(spark):
    page = "<body><div>Site</div><article><h1>Head {i}</h1><p>Text {i}</p><h2>Conclusion</h2><p>More {i}</p>{quote}</article></body>"
    quote = "<blockquote>Three copies hold this</blockquote>"
    got = extracted(spark, [(i, "http://h.org/", page.format(i=0 if i < 3 else i, quote=quote if i < 3 else "")) for i in range(40)])
    assert all(got[i][0] == "Head 0 Text 0 Conclusion More 0 Three copies hold this" for i in range(3))
    assert all(got[i][0] == f"Head {i} Text {i} Conclusion More {i}" for i in range(3, 40))
    copies = extracted(spark, [(i, "http://i.org/", "<article><h1>One head</h1><p>One</p><p>Two</p></article>") for i in range(5)])
    assert {t for t, _ in copies.values()} == {"One head One Two"}


def test_odd_input(spark):
    deep = "<div>" * 500 + "deep"
    rows = [(1, None, None), (2, "x", ""), (3, "http://e.org", "plain &lt;text&gt; 1 < 2"), (None, None, "<p>a<p>b</div></p>c"), (5, "http://e.org", deep), (6, "http://f.org", "<!-- open"), (7, "http://f.org", "<p>" + "word " * 200_000)]
    got = extracted(spark, rows)
    assert got[1] == got[2] == got[6] == ("", 0)
    assert got[3][0] == "plain <text> 1 < 2"
    assert got[None][0] == "a b c"
    assert got[5][0] == "deep"
    assert got[7][1] == 5 * 200_000 - 1


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "http://a.org", "<p>a</p>", "h", "t")], "page_id long, url string, html string, host string, template string")
    assert html.extract(df).first()["text"] == "a"
    assert html.extract(df.limit(0)).collect() == []


def test_layout_words_and_an_articles_own_head(spark):
    page = '<div class="page-with-sidebar"><div class=sidebar>side {i}</div><article><div class="article-header"><h1>Head {i}</h1></div><p>Body {i}</p><section class="comments"><article>said {i}</article></section></article></div>'
    got = extracted(spark, [(i, "http://g.org/", page.format(i=i)) for i in range(4)])
    assert got[3][0] == "Head 3 Body 3"


def test_matching_aligns_by_weight():
    a, b = html.parse("<ul><li>x</li></ul><p>y</p>")[0], html.parse("<p>y</p><ul><li>x</li></ul>")[0]
    assert html.match(a.children, b.children, {}) == [(0, 1)]
    assert html.settled(html.weight(a, b, {})) == 3
    again = html.Node.load(a.dump())
    assert again.dump() == a.dump()


WORDY = """<html><body><ul><li><a href=1>Home {i}</a></li><li><a href=2>About</a></li></ul><div class="{ad}">Buy {i} now</div>
<{tag}><h1>Head {i}</h1><p>{body}</p><p>Same last words</p></{tag}><div class="{end}">Mail us {i}</div></body></html>"""


def wordy(i, tag="article", ad="ad", end="footer"):
    return WORDY.format(i=i, tag=tag, ad=ad, end=end, body=" ".join(f"w{i * k}" for k in range(1, 30)))


def test_slots_find_the_content_without_names(monkeypatch):
    """No article element, no telling names, empty lists: the slots alone give the same text, constant blocks in the content included."""
    want = [f"Head {i} {' '.join(f'w{i * k}' for k in range(1, 30))} Same last words" for i in range(8)]
    for words in (True, False):
        if not words:
            for name in ("SKIPPED_TAGS", "SKIPPED_ROLES", "SKIPPED_WORDS", "MAIN_WORDS"):
                monkeypatch.setattr(html, name, frozenset())
        for tag, ad, end in (("article", "ad", "footer"), ("div", "x", "y"), ("section", "ad", "y")):
            pages = [wordy(i, tag, ad, end) for i in range(8)]
            template = None
            for p in pages:
                tree = html.parse(p)[0]
                template = tree if template is None else html.merge(template, tree)
            assert [html.main_text(p, template) for p in pages] == want


def test_induction_settles_what_one_page_cannot():
    """A short article beside a long constant notice without a name: alone the page is taken for the notice, the host's pages say otherwise."""
    page = "<body><div class=a><p>Long words that every page of the host repeats, again and again, to no end at all</p></div><div class=b><p>Short {i}</p></div></body>"
    pages = [page.format(i=i) for i in range(6)]
    template = None
    for p in pages:
        tree = html.parse(p)[0]
        template = tree if template is None else html.merge(template, tree)
    assert [html.main_text(p, template) for p in pages] == [f"Short {i}" for i in range(6)]
    assert html.main_text(pages[0], None) != "Short 0"


def test_headings_that_never_change_stay(spark):
    page = "<body><nav>menu</nav><article><h1>Head {i}</h1><p>Text {i}</p><h2>Discussion</h2><p>More {i}</p></article></body>"
    got = extracted(spark, [(i, "http://k.org/", page.format(i=i)) for i in range(9)])
    assert {got[i][0] for i in range(9)} == {f"Head {i} Text {i} Discussion More {i}" for i in range(9)}


def test_very_deep_pages(spark):
    deep = "<div>" * 10_000 + "<p>deep {i} words</p>" + "</div>" * 10_000
    other = "<div><ul><li>x</li></ul>" + "<div>" * 9_000 + "<p>other {i}</p>"
    rows = [(i, "http://deep.org/", deep.format(i=i)) for i in range(3)] + [(10 + i, "http://deep.org/", other.format(i=i)) for i in range(3)]
    got = extracted(spark, rows)
    assert [got[i][0] for i in range(3)] == [f"deep {i} words" for i in range(3)] and all("other" in got[10 + i][0] for i in range(3))


def test_templates_are_bounded():
    """Class names of random letters never match; what few pages have leaves the template, the content stays found."""
    template = None
    for i in range(400):
        noise = "".join(f'<div class="r{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}">n</div>' for k in range(20))
        tree = html.parse(f"<body>{noise}<div class=text><p>Own words {i} {'of the page ' * 20}</p></div></body>")[0]
        template = html.pruned(tree if template is None else html.merge(template, tree), 200)
    assert len(template.below()) <= 225
    assert [n.key for n in html.content_path(template)[0]][-1] == "div class=text"
