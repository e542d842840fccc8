import html
import re

from vantage.llm import extraction as X


def text(page, low=frozenset()):
    return X.Page(page).main_text(low)[0]


def test_structure():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p><p>x';</script></head><body>"
        "<nav><a href=/>Home</a></nav><!-- <p>no</p> --><div class='ad box'>Buy</div><article><h1>One &amp;  two</h1>"
        "<p>Some <b>bold</b>\n text<p>Next<br>line &#233;&lt;<ul><li>a<li>b</ul><form><p>f</form>"
        "<div id=comments><p>first!</div><aside>side</aside></article><footer>&copy; x</footer></body></html>"
    )
    assert text(page) == "One & two\nSome bold text\nNext line é<\na\nb"


def test_odd_pages():
    assert text("") == ""
    assert text("plain words") == "plain words"
    assert text("<p>cut <a href='x") == "cut"
    assert text("<p>a</nav></p>b") == "a\nb"
    assert text("<article><p>x</article><p>outside") == "x"
    assert text("<p hidden>h<p style='display: none'>n<p aria-hidden=true>t<p>shown") == "shown"
    assert text("<p>" + "long " * 200_000) == ("long " * 200_000).strip()
    assert text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n2\n3"
    assert text("<p>&amp &am &nosuch; &#x41;") == "& &am &nosuch; A"


def test_unimportant_branches_go(spark):
    rows = []
    for k in range(12):
        page = f"<body><div class=top><p>Same slogan</p></div><div class=story><p>Story {k} alone</p><p>More {k * k}</p></div></body>"
        rows.append((k, f"http://www.a.example/{k}", page))
    rows += [(100, "http://b.example/", rows[0][2]), (101, None, None), (101, None, None), (102, "rel", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'mine' AS text", "'x' AS host")
    out = {(r.page_id, r.n_branches): r.text for r in X.extract_main_text(pages).collect()}
    assert out[3, 1] == "Story 3 alone\nMore 9"
    assert out[100, 0] == "Same slogan\nStory 0 alone\nMore 0"  # a single page of its host
    assert out[101, 0] == out[102, 0] == ""
    tree = X.style_tree(pages.where("url LIKE 'http://www%'").withColumnRenamed("host", "h").selectExpr("'a' AS host", "html"))
    got = sorted((r.pages, round(r.content, 2)) for r in tree.collect() if r.content is not None)
    assert got == [(12, 0.0), (12, 1.0)]


def test_undeclared_blocks_in_articles_go(spark):
    """Repeated paragraphs, lists and tables inside articles go; headings and parts of own tables stay."""
    rows = []
    for k in range(12):
        page = (
            f"<body><article><h1>Title {k}</h1><p>Get our letter each week</p><p>Story {k} alone</p><h2>Figures</h2>"
            f"<table><tr><th>Year<th>Sum<tr><td>{k}<td>{k * 7}</table><ul><li><a href=/x>Send</a><li><p>Print</ul>"
            f"<div><table><tr><td>About<td>Jobs</table></div><p class=more>Read on</p><ul><li>Same<li>Own {k}</ul><p>More {k * k}</p></article></body>"
        )
        rows.append((k, f"http://a.example/{k}", page))
    rows += [(50 + k, "http://b.example/", "<article><p>Only text</p></article>") for k in range(12)]
    out = {r.page_id: r for r in X.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(12):
        assert out[k].text.split("\n") == [f"Title {k}", f"Story {k} alone", "Figures", "Year", "Sum", str(k), str(k * 7), "Same", f"Own {k}", f"More {k * k}"]
        assert out[k].n_branches == 4 and out[50 + k].text == "Only text"


def test_copies_of_one_page_stay_whole(spark):
    rows = [(k, "http://a.example/", "<body><div><p>Only text</p></div></body>") for k in range(20)]
    out = X.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.text for r in out.collect()} == {"Only text"} and out.count() == 20


def test_empty_table(spark):
    assert X.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_driver_pages(spark, small):
    """The article of each page, cut out by expressions that fit these pages only."""
    pages = spark.read.parquet(f"{small}/pages.parquet")
    found = {r.page_id: (r.text, r.n_chars) for r in X.extract_main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [re.sub(r"<br>", " ", re.sub(r"</?b>", "", x)) for x in re.split(r"</?(?:h1|p)>", article)]
        lines = [" ".join(html.unescape(x).split()) for x in blocks]
        expect = "\n".join(x for x in lines if x)
        assert found[r.page_id] == (expect, len(expect))


def test_wrappers_headers_and_comments():
    page = (
        "<body><header><h1>Site</h1></header><div class='with-sidebar has-ads'><article><header class=entry-header><h1>Title</h1>"
        "</header><p>Body<section id=comments><article><p>me too</article></section></article><div class=sidebar>side</div></div>"
        "<div id='page-header'>top</div>"
    )
    assert text(page) == "Title\nBody"
    assert text("<div class=masthead>m</div><p>x") == "x"
    assert text("<main><p>a</main><article class='comment'>c</article>") == "a"
