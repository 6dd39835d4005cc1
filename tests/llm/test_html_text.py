import pytest

from ragloom.llm import html_text

P = "The first paragraph of the article is long enough to be a surge of text on its own, says the test. " * 2


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(50)
    for r in html_text.with_main_text(pages).collect():
        assert r["text"] and "track(" not in r["text"] and "©" not in r["text"] and "<" not in r["text"]


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("   \n", ""), ("<p></p>", ""),
    ("<article><h1>A &amp; B</h1><p>x\n  y&nbsp;z<p>w<br>v</article>", "A & B\nx y z\nw v"),
    ("<article><header><h1>T</h1></header><p>a</p><footer>f</footer></article><footer>g</footer>", "T\na"),
    ("<body><header>Site</header><nav>menu</nav><main><p>a<b>b</b>c</p><aside>side</aside><form>f<input></form><p>Wh.</p></main></body>", "abc\nWh."),
    ("<article><p>a</p><div class='ad-slot'><p>buy</p><div>now</div></div><p>b</p></article><section id=comments><article><p>c</p></article></section>", "a\nb"),
    ("<article><p>a</p><div class=\"cookie-notice\">ok?</div><script>if (a<b) x('</p>')</script><style>p{}</style><!-- <p>no</p> --><p>b", "a\nb"),
    ("<article class=comment><p>c</p></article><article><p>a</p></article>", "a"),
    ("<article><p>1 &lt; 2 &#65;&eacute; &am &amp</article>", "1 < 2 Aé &am &"),
    (f"<body><ul><li><a href=x>Home</a></li><li><a href=y>About</a></li></ul><div><h2>Title</h2><p>{P}</p><p>Short.</p></div><div role=contentinfo>c</div></body>",
     f"Title\n{P.strip()}\nShort."),
    ("plain text only", "plain text only"), ("a < b and c > d", "a < b and c > d"), ("<article><p>end <a href='", "end"),
    ("<article><pre>a\n\tb</pre><ul><li>one<li>two</ul><table><tr><td>x</td><td>y</td></tr></table></article>", "a b\none\ntwo\nx\ny"),
    ("<ARTICLE><P CLASS=x>Up</P><NAV>n</NAV></ARTICLE>", "Up"),
])
def test_pages(page, want):
    assert html_text.main_text(page) == want


def test_surge_and_dive():
    assert list(html_text.kept_lines([0, 0, 10, 90, 5, 0, 0, 0, 0, 20, 0, 0, 0, 0, 100], 80)) == [2, 3, 4, 14]
    assert list(html_text.kept_lines([], 80)) == []
    assert list(html_text.kept_lines([30, 30, 30], 80)) == [0, 1, 2]


def test_long_page_and_extra_columns(spark):
    body = "".join(f"<p>{k} word</p>" for k in range(20_000))
    df = spark.createDataFrame([(1, "u", f"<article>{body}</article>", "old"), (1, None, None, None)],
                               "page_id long, url string, html string, text string")
    got = html_text.with_main_text(df).collect()
    assert got[0]["text"].count("\n") == 19_999 and got[1]["text"] == ""
    assert html_text.with_main_text(df.limit(0)).count() == 0


CARD = "<article class='{}'><h3><a href=x>Other news</a></h3><p>A teaser of some other page, cut after a few words and ended by dots, as they are on such lists ...</p></article>"
BODY = f"<h1>Title</h1><p>{P}</p><p>{P}</p><p>{P}</p><p>The end.</p>"
BODY_TEXT = "\n".join(["Title", P.strip(), P.strip(), P.strip(), "The end."])


@pytest.mark.parametrize("name", ["card", "teaser", "post-preview"])
@pytest.mark.parametrize("cards", [1, 3, 10])
def test_body_beside_teaser_articles(name, cards):
    teasers = CARD.format(name) * cards
    assert html_text.main_text(f"<nav>menu</nav><div>{BODY}</div>{teasers}<footer>f</footer>") == BODY_TEXT
    assert html_text.main_text(f"{teasers}<section>{BODY}</section>") == BODY_TEXT


def test_articles_and_text_outside():
    short = "<article><p>A short post.</p></article>"
    assert html_text.main_text(f"<p>Filed under x</p>{short}<article>{BODY}</article><p>Filed under x</p>") == f"A short post.\n{BODY_TEXT}"
    assert html_text.main_text(f"<article><h1>Title</h1><p>{P}</p></article><div><p>{P}</p><p>{P}</p><p>The end.</p></div>") == BODY_TEXT
    assert html_text.main_text(f"<article>{BODY}</article><div><p>{P}</p><p>{P}</p></div>") == f"{BODY_TEXT}\n{P.strip()}\n{P.strip()}"


def test_short_isolated_blocks():
    gap = "<nav>a</nav><nav>b</nav><nav>c</nav>"
    assert html_text.main_text(f"<p>Skip to text</p>{gap}<div>{BODY}</div>{gap}<p>Top of page</p>{gap}{CARD.format('card')}") == BODY_TEXT


@pytest.mark.parametrize("wrapper", [
    "class='site no-sidebar'", 'class="content has-sidebar"', "class=elementor-widget", "class='social-share-top'", "id=comments-enabled",
    "title='the class=menu of it'", "class='page' title=\"a > b class='ad'\"", "data-role=navigation", "data-id='reply-7'"])
def test_layout_names_do_not_silence_the_page(wrapper):
    for page in (f"<nav>menu</nav><div {wrapper}><article>{BODY}</article></div><footer>f</footer>", f"<div {wrapper}>{BODY}</div>",
                 f"<article><div {wrapper}>{BODY}</div></article>"):
        assert html_text.main_text(page) == BODY_TEXT
    blocks = "".join(f"<div {wrapper}>{x}</div>" for x in BODY.split("</p>") if x)  # a name on every block
    assert html_text.main_text(f"<article>{blocks}</article>") == BODY_TEXT


def test_names_still_mark_parts():
    aside = f"<div class='sidebar'><p>{P}</p></div><section id='comments'><p>{P}</p><p>{P}</p><p>{P}</p><p>{P}</p><p>{P}</p></section>"
    assert html_text.main_text(f"<div class='layout has-sidebar'><article>{BODY}</article>{aside}</div>") == BODY_TEXT
    assert html_text.main_text(f"<article>{BODY}{aside}</article>") == BODY_TEXT
    assert html_text.main_text(f"<article><div data-id='reply-7'><p>a</p></div><div data-role='navigation'><p>b</p></div><div class=ad><p>c</p></div></article>") == "a\nb"


def test_repeated_pages(spark):
    df = spark.createDataFrame([(1, f"<div class='site no-sidebar'>{BODY}</div>")] * 3, "page_id long, html string")
    assert [r["text"] for r in html_text.with_main_text(df).collect()] == [BODY_TEXT] * 3
