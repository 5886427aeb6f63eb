import html
import re

from gridweave.llm import htmltext
from gridweave.llm.queries import op2_html_text

SF = "/root/testdata/sf0.01"


def plain(page):
    """The article of the test table's pages, by their known layout."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|br|h1)\s*/?>", article)
    return " ".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts) if x)


def test_whole_table_against_its_layout(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op2_html_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain(pages[r.page_id]) and r.n_chars == len(r.text)


def test_template_words_and_parts(spark):
    def page(i):
        return f"""<!DOCTYPE html><html><head><title>t{i}</title></head><body class="has-sidebar">
        <div class="top-menu"><a href=x>Home {i}</a></div><div><p>Welcome to our site!</p></div>
        <div id=content><h1>Title {i}</h1><p>Fish &amp; chips<b>{i}</b>&nbsp;x<br>next<!-- no --> line {i}<script>"</p>no"</script></p><p class="notice">no {i}
        <p>Last {i} a &lt; b</div><form><label>no {i}</label></form><section class="comments"><article>no {i}</article></section><p>All rights kept</p><footer>no {i}</footer></body></html>"""

    pages = spark.createDataFrame([(i, "http://H.example/%d" % i, page(i), "z") for i in range(8)] + [(100 + i, f"http://h{i}.example/", page(i), "z") for i in range(3)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    for i in range(8):
        assert got[i] == f"Title {i} Fish & chips{i} x next line {i} Last {i} a < b"
    assert got[100] == "Welcome to our site! Title 0 Fish & chips0 x next line 0 Last 0 a < b All rights kept"


def test_copies_keep_their_text_and_edges(spark):
    same = "<body><p>One text</p><p>on all pages</p></body>"
    rows = [(i, "http://a.example/x", same) for i in range(9)] + [(20, None, same), (21, "http://[bad", same), (22, "http://a.example/", None), (23, "http://a.example/", ""), (24, "x", "no tags < at <all"), (25, "x", "<nav>" * 100_000), (26, "x", "<p" * 200_000), (27, "x", "<!--" * 100_000 + "a"), (28, "x", "<nav><ul><li>no<article>yes</article>"), (28, "x", "<nav><ul><li>no<article>yes</article>")]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in (*range(9), 20, 21)} == {"One text on all pages"}
    assert got[22] == got[23] == got[25] == got[27] == "" and got[24] == "no tags < at <all" and got[28] == "yes"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert htmltext.extract(empty).count() == 0


def texts(spark, pages):
    rows = [(i, f"http://{host}/{i}", page) for i, (host, page) in enumerate(pages)]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_repeated_boxes_go_inside_an_article_too(spark):
    def page(i):
        return f"<body><article><h1>Title {i}</h1><p>Text {i} of the story<div class='vita'><p>Ann writes here about the town and its people.</div><p>Read us by mail</article></body>"

    got = texts(spark, [("a.example", page(i)) for i in range(8)] + [("b.example", page(8))])
    assert got[:8] == [f"Title {i} Text {i} of the story" for i in range(8)]
    assert got[8] == "Title 8 Text 8 of the story Ann writes here about the town and its people. Read us by mail"
    copy = "<body><i>%d</i><main><p>One text that all pages have</p></main></body>"
    assert texts(spark, [("a.example", copy % i) for i in range(8)]) == ["One text that all pages have"] * 8


def test_a_teaser_article_beside_the_main_div(spark):
    def page(i, teaser, n=1):
        return f"<body><div class='story'><h1>Title {i}</h1><p>A long story {i} that fills the page, <b>word</b> after word after word.</p><div>And more {i}.</div></div>" + f"<article><a href=x>{teaser}</a></article>" * n + "</body>"

    want = [f"Title {i} A long story {i} that fills the page, word after word after word. And more {i}." for i in range(8)]
    assert texts(spark, [("a.example", page(i, f"Next: {i + 1}")) for i in range(8)]) == want
    assert texts(spark, [("a.example", page(i, "Read this now")) for i in range(8)]) == want
    assert texts(spark, [(f"h{i}.example", page(i, f"Next: {i + 1}")) for i in range(8)]) == want
    # Where neither side outweighs the other, nothing is lost.
    assert texts(spark, [("c.example", page(1, "Next: 2", 9))]) == [want[1] + " Next: 2" * 9]
    # A short article keeps its hint beside a longer line of the site.
    assert texts(spark, [("c.example", "<body><p>Seen by 12345 people</p><article>Rain at noon.</article></body>")]) == ["Rain at noon."]


def test_names_drop_parts_but_not_the_page(spark):
    story = "<h1>Title</h1><p>All that the page has to say, in more words than the menu has.</p>"
    want = "Title All that the page has to say, in more words than the menu has."
    wraps = ["<div class='page has-sidebar'>%s</div>", "<div id='content' class='no-ads'>%s</div>", "<div class='widget'>%s</div>", "<div class='banner'><div class='promo-box main-menu'>%s</div></div>"]
    pages = [f"<body><div class='top-menu'>Home</div>{w % story}<p class='notice'>no</p><div class='comment-list'>{'no ' * 99}</div></body>" for w in wraps]
    assert texts(spark, [(f"h{i}.example", p) for i, p in enumerate(pages)]) == [want] * len(pages)
    headline = "<body><div><div class='article-header'><h1>Title</h1></div><p>A text of some words.</p></div><div class='site_footer share'>no</div></body>"
    left = "<body><nav>no</nav><div class='ad'>one</div><div class='promo'>two</div></body>"
    advert = f"<body><div class='ad'>{'no ' * 99}</div><article>One word<div class='share'>{'no ' * 99}</div></article></body>"
    assert texts(spark, [("a.example", headline), ("b.example", left), ("c.example", advert)]) == ["Title A text of some words.", "one two", "One word"]


def as_divs(page):
    """The page with neither names nor elements that tell what they hold."""
    return re.sub(r"<(/?)(?:article|main|header|footer|nav|aside|form)>", r"<\1div>", re.sub(r'\s(?:class|id|role)="[^"]*"', "", page))


def test_template_decides_where_nothing_is_named(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    want = {r.page_id: plain(r.html) for r in pages}
    df = spark.createDataFrame([(r.page_id, r.url, as_divs(r.html)) for r in pages], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.96 * len(want)
    # Without a template no page comes out right, and by its own slots alone fewer do.
    assert all(htmltext.main_text(as_divs(r.html), frozenset()) != want[r.page_id] for r in pages)
    assert sum(htmltext.main_text(as_divs(r.html)) == want[r.page_id] for r in pages) < sum(got[i] == want[i] for i in want)
    # Joined by a shuffle, templates give the same.
    assert {r.page_id: r.text for r in htmltext.extract(df, broadcast_tokens=0).collect()} == got


def test_classes_against_whole_vectors(spark):
    """All vectors of a host side by side: tokens of equal vectors, two at least, as often on each page, on half of the pages."""
    shapes = ["<div><h1>T{i}</h1>x{i}</div>", "<div class=m><ul><li>Home<li>About</ul></div>", "<div>Sold here{odd}</div>", "<p>Once more</p>" * 2, "<section><p>Once more</p><p>{i}</p></section>", "<div>{third}</div>"]
    rows = []
    for i in range(40):
        body = "".join(s.format(i=i, odd="!" * (i % 2), third="" if i % 3 else "Now") for k, s in enumerate(shapes) if (i + k) % 5)
        rows.append((i, f"http://h{i % 7 % 4}.example/{i}", f"<body>{body}<footer>All rights kept</footer></body>"))
    rows += [(100, "http://lone.example/", rows[0][2]), (101, None, rows[0][2]), (102, "http://h1.example/x", None)]
    rows += [(200 + i, r.url, r.html) for i, r in enumerate(spark.read.parquet(f"{SF}/pages.parquet").limit(60).collect())]
    got = htmltext.template_tokens(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    hosts = {}
    for i, url, page in rows:
        if page is not None and htmltext.host_of(url):
            out = htmltext.parse(page)
            hosts.setdefault(htmltext.host_of(url), []).append((out.token, [out.text_token(b) for b in out.blocks]))
    want = set()
    for host, pages in hosts.items():
        classes = {}
        for token in {t for elements, texts in pages for t in elements + texts}:
            classes.setdefault(tuple((e + x).count(token) for e, x in pages), []).append(token)
        elements = {t for e, _ in pages for t in e}
        for vector, tokens in classes.items():
            on = [n for n in vector if n]
            if len(on) > 1 and 2 * len(on) >= len(pages) and sum(on) % len(on) == 0 and len(set(on)) == 1 and sum(1 + (t in elements) for t in tokens) > 1:
                want |= {(host, t) for t in tokens}
    assert {(r.host, r.token % 2**64) for r in got} == want and len(want) > 50


def test_clashing_names_and_deep_names(spark):
    page = "<body><article>One text</article></body>"
    names = "tokens host boxes rest token around kind pages salt n text n_chars".split()
    df = spark.createDataFrame([(1, "http://a.example/1", page, *range(len(names)))], "page_id long, url string, html string, " + ", ".join(f"{n} int" for n in names))
    for most in (1_000_000, 0):
        row = htmltext.extract(df, broadcast_tokens=most).first()
        assert row.text == "One text" and row.n_chars == 8 and row.tokens == 0 and row.salt == 8
    # Names count however deep they are.
    deep = "<body><div>" + "<div class='box-%d'>" % 1 * 3 + "<div class='ad'>" * 80 + "<div>no</div>" + "</div>" * 83 + "All that the page has to say.</div></body>"
    assert texts(spark, [("b.example", deep)]) == ["All that the page has to say."]
