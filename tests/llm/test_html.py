import random

from tesselon.llm import html_extraction as H

SCHEMA = "page_id long, url string, html string, path string"


def pages(spark, *rows):
    return spark.createDataFrame([(*r, "p") for r in rows], SCHEMA).repartition(3)


def text(html):
    return " ".join(t for z, t in H.lines_of(html) if z == H.ARTICLE)


def test_zones():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>";</script></head><body><nav><ul><li>Menu</li></ul></nav>
    <!-- <p>no</p> --><div class="ad">Buy</div><article><header><h1>Head&amp;line</h1></header><p>One <b>bo</b>ld&nbsp; &lt;x&gt; 1 < 2<p>Two<br>lines
    <div class='user-comments'><p>first!</p></div><table><tr><td>c1<td>c2</table><aside>side</aside><form><input>go</form></article><footer>&copy; f</footer></body></html>"""
    assert text(page) == "Head&line One bold <x> 1 < 2 Two lines c1 c2"
    assert text("<article><p>a</article><p>after") == "a"
    assert text("<main><p>cut of") == "cut of" and text("<article>x <p") == "x"
    assert H.lines_of(None) == [] and H.lines_of("") == []
    assert [t for _, t in H.lines_of("plain   text")] == ["plain text"]


def test_common_lines():
    rng = random.Random(1)

    def lcs(a, b):
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
        return m[-1][-1]

    for _ in range(1500):
        a, b = [rng.randrange(5) for _ in range(rng.randrange(10))], [rng.randrange(5) for _ in range(rng.randrange(10))]
        got = H.common_lines(a, b)
        rest = iter(b)
        assert len(got) == lcs(a, b) and all(a[i] in rest for i in got)


def test_differencing(spark):
    page = lambda own: f"<body><div>Site name</div><p>{own}</p><p>Read more</p></body>"
    rows = [(1, "http://a.x/en/1", page("one")), (2, "http://www.a.x/en/2", page("two")), (3, "http://b.x/en/1", page("alone")), (4, None, None), (5, "http://a.x/de/9", "<article><p>Site name</p></article><p>Read more</p>"), (6, "http://[bad", "<p>x</p>")]
    got = {r.page_id: (r.text, r.partner, r.n_shared) for r in H.extract(pages(spark, *rows)).collect()}
    assert got[1][0] == "one" and got[2][0] == "two" and got[1][1] == 2 and got[1][2] == 2
    assert got[3] == ("Site name alone Read more", None, 0)
    assert got[4][0] == ""
    assert got[5][0] == "Site name"
    assert got[6][0] == "x"


def test_repeated_rows_and_empty(spark):
    row = (1, "http://a.x/1", "<article><p>same</p></article>")
    assert [r.text for r in H.extract(pages(spark, row, row)).collect()] == ["same", "same"]
    assert H.extract(pages(spark, row).limit(0)).count() == 0


def test_whole_table(spark):
    import html
    import re

    sf = "/root/testdata/sf0.001"
    rows = {r.page_id: r for r in H.op8_html_extraction(spark, sf).collect()}
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(p|h1|br)>", " ", body).replace("<b>", "").replace("</b>", "")).split())
        assert rows[p.page_id].text == want and rows[p.page_id].n_chars == len(want)


def test_wrappers_named_as_boilerplate():
    assert text('<div class="content has-sidebar"><article><p>a</p></article></div>') == "a"
    assert text('<div class="elementor-widget widget"><div><main><p>a</p><div class="ad">x</div></main></div><p>b</p></div>') == "a"
    assert text('<article><p class="market-share">a</p><div class="social-history">b</div><div class="social share">c</div></article>') == "a b"
    assert text('<div class="related"><article>card</article></div><article>a<div class="related"><article>card</article></div></article>') == "a"
    assert text('<nav><div class="widget"><article>x</article></div></nav><div role="navigation"><article>y</article></div>') == ""
    assert text('<div class="widget"><aside><article>x</article></aside></div>') == ""


def test_broken_quotes_lose_nothing():
    assert text("<article><p>a</p><p it's>b</p><p>c</p></article>") == "a b c"
    assert text('<article><p class="x>b</p><p class="y">c</p></article>') == "b c"
    assert text("<article><p title='a > b' data-x=\"1 < 2 > 1\">b</p><a href=x?a=1&b='2>c</a></article>") == "b c"
    assert text('<article><p data-id="ad">a</p><p data-class="x">b</p></article>') == "a b"


def test_adverts_in_any_element():
    assert text('<article><p>a<p class="advert">Buy<p>b</article>') == "a b"
    assert text('<article><ul><li>a<li class="share">Tweet<li>b</ul>c</article>') == "a b c"
    assert text('<article><table><tr><td>a<td class="ad">Buy</td><tr class="promo"><td>x<td>y<tr><td>b</table></article>') == "a b"
    assert text('<article><p>a <span class="ad">Buy <span>now</span> and</span>b <i>c</i></p></article>') == "a b c"
    assert text('<article><p>a <b>b<i>c</b>d</i> e<p>f</article>') == "a bcd e f"
    assert text('<article><div class="ad"><p>x<div>y</div><p>z</div><p>a</article>') == "a"


def test_copies_are_no_partners(spark):
    page = lambda own, more="": f"<div>Site name</div>{more}" + "".join(f"<p>{own} {k}</p>" for k in range(20)) + "<p>Read more</p>"
    rows = [(k, f"http://a.x/en/{k}", page("one")) for k in range(5)] + [(10, "http://a.x/en/3b", page("two")), (11, "http://b.x/1", page("three")), (12, "http://b.x/2", page("three", "<p>today</p>"))]
    got = {r.page_id: r for r in H.extract(pages(spark, *rows)).collect()}
    for k in range(5):
        assert got[k].text == " ".join(f"one {i}" for i in range(20)) and got[k].partner == 10
    assert got[10].text == " ".join(f"two {i}" for i in range(20))
    assert "three 7" in got[11].text and "three 7" in got[12].text and got[11].partner is None


def test_text_follows_the_neighbour_where_no_article_is_declared(spark):
    mine = (1, "http://a.x/1", "<p>Read more</p><p>mine</p><p>Contact</p>")
    for other, want in (("<p>Read more</p><p>x</p>", "mine Contact"), ("<p>y</p><p>Contact</p>", "Read more mine"), ("<p>z</p>", "Read more mine Contact")):
        got = {r.page_id: r.text for r in H.extract(pages(spark, mine, (2, "http://a.x/2", other))).collect()}
        assert got[1] == want


def test_main_around_articles():
    zones = lambda html: [(z, t) for z, t in H.lines_of(html) if z != H.BOILERPLATE]
    long = "text " * 9 + "end"
    assert zones(f"<main><p>a</p><article><header>h</header>{long}</article><header>b</header><nav>n</nav></main><p>c</p>") == [(H.FRAME, "a"), (H.ARTICLE, "h"), (H.ARTICLE, long), (H.FRAME, "b"), (H.OPEN, "c")]
    assert zones(f'<div class="widget"><main>a<article>{long}</article></main></div>') == [(H.FRAME, "a"), (H.ARTICLE, long)]
    assert zones(f"<article>{long}<main>a</main></article>") == [(H.ARTICLE, long), (H.ARTICLE, "a")]
    # a main element that holds no article, or mostly text of its own, is the article
    assert zones(f"<main>a</main><article>{long}</article>") == [(H.ARTICLE, "a"), (H.ARTICLE, long)]
    assert zones(f"<main>{long}<article>a</article></main>") == [(H.ARTICLE, long), (H.ARTICLE, "a")]


def framed(own, path="News", more="More stories", menu="Menu", head=True):
    title = f"<h1>Title {own}</h1>" if head else ""
    return f"<nav>{menu}</nav><main><div>{path}</div>{title}<article><p>{own} one</p><p>{own} two two two</p><p>Same words in both</p></article><div>{more}</div></main>"


def test_text_follows_the_neighbour_beside_a_declared_article(spark):
    mine, body = (1, "http://a.x/1", framed("mine")), "mine one mine two two two Same words in both"
    for other, want in (
        (framed("other"), f"Title mine {body}"),
        (framed("other", path="Sport"), f"News Title mine {body}"),
        (framed("other", more="Older"), f"Title mine {body} More stories"),
        (framed("mine", menu="Another menu"), f"News Title mine {body} More stories"),  # a copy is no partner
        ("<p>News</p><p>Same words in both</p>", f"Title mine {body} More stories"),
    ):
        got = {r.page_id: r.text for r in H.extract(pages(spark, mine, (2, "http://a.x/2", other))).collect()}
        assert got[1] == want


def test_pages_with_equal_frames_are_partners(spark):
    rows = [(k, f"http://a.x/{k}", framed(f"p{k}", head=False)) for k in range(4)] + [(9, "http://a.x/2b", framed("p2", head=False))]
    got = {r.page_id: r for r in H.extract(pages(spark, *rows)).collect()}
    for k in (0, 1, 2, 3, 9):
        own = "p2" if k == 9 else f"p{k}"
        assert got[k].text == f"{own} one {own} two two two Same words in both" and got[k].partner is not None
    assert got[9].partner == got[2].partner != 2


def test_copies_with_other_menus_keep_their_text(spark):
    page = lambda menu: "<nav>" + "".join(f"<li>{menu} {k}</li>" for k in range(5)) + "</nav><p>one</p><p>two</p>"
    got = {r.page_id: (r.text, r.partner) for r in H.extract(pages(spark, (1, "http://a.x/1", page("a")), (2, "http://a.x/2", page("b")))).collect()}
    assert got == {1: ("one two", None), 2: ("one two", None)}


def test_query_takes_shared_lines_from_frames(spark, tmp_path):
    pages(spark, *[(k, f"http://a.x/{k}", framed(f"p{k}")) for k in range(3)]).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in H.op8_html_extraction(spark, str(tmp_path)).collect()}
    for k in range(3):
        want = f"Title p{k} p{k} one p{k} two two two Same words in both"
        assert got[k] == (want, len(want))
