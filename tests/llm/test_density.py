import html
import re
import time

import pandas as pd

from llm import density, queries

SF = "/root/testdata/sf0.01"
PROSE = "Some longer words of an article that goes on for a while. " * 6


def test_chrome_goes_and_the_article_stays():
    page = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><header><h2>Site</h2></header><nav><a href=x>Home</a></nav>
    <div class="cookie-notice">We use cookies</div><div id=content class="with-sidebar"><h1>Title &amp; more</h1><div class=entry><p>{PROSE}<p>Second
      paragraph <b>bold</b>ly {PROSE}<ul><li>one<li>two</ul><form>mail <input></form></div><div class="comments"><p>{PROSE}</p></div></div>
    <aside>{PROSE}</aside><script>if (a < b) {{ "</p>" }}</script><!-- {PROSE} --><footer>&copy; us</footer>"""
    want = ["Title & more", PROSE.strip(), "Second paragraph boldly " + PROSE.strip(), "one", "two"]
    assert density.main_text(page).split("\n") == want


def test_odd_pages():
    for page, want in ((None, ""), ("", ""), ("plain &lt; text", "plain < text"), ("<p>a<br>b", "a b"), ("a <div", "a"), ("a < b", "a < b"), ("a < b <i>c</i>", "a < b c"),
                       ("<div>" * 3000 + "deep", "deep"), ("</p></b>x</table>", "x"), ("<script>x", ""), ("<!-- x", ""), ("<p title='a > b'>c</p>", "c"),
                       ("<p>a&nbsp;b</p>\n<p> </p>", "a b"), ("<nav>x</nav>", "")):
        assert density.main_text(page) == want, page
    assert len(density.main_text("<p>word " * 50_000)) > 200_000


def test_density_picks_the_article_without_names():
    links = "".join(f'<li><a href="{i}">link {i}</a></li>' for i in range(30))
    page = f"<body><div><ul>{links}</ul></div><div><p>{PROSE}</p><p>{PROSE}</p></div><div><a>x</a><a>y</a></div></body>"
    assert density.main_text(page) == PROSE.strip() + "\n" + PROSE.strip()


def test_a_form_around_the_page_is_no_form(spark):
    """Server-rendered pages stand in one form; forms beside or within the article go."""
    small = "<form action=x><label>mail</label><input></form>"
    for article in (f"<article><h1>T</h1><p>{PROSE}</p>{small}<p>{PROSE}</p></article>", f"<h1>T</h1><div><p>{PROSE}</p>{small}<p>{PROSE}</p></div>",
                    f"<div><p>{PROSE}</p>{small}<p>{PROSE}</p></div>"):
        page = f"<body><form id=aspnetForm><nav>menu</nav>{article}</form>{small}</body>"
        want = [*(["T"] if "<h1>" in article else []), PROSE.strip(), PROSE.strip()]
        assert density.main_text(page).split("\n") == want


def test_names_within_an_article():
    """A telling word beside another says nothing, nor does it on prose; alone, or where it is foreign to articles, it does."""
    kept = (f'<div class="social history"><p>{PROSE}</p></div><table class="form"><tr><td>cell</td></tr></table><p id="search">found {PROSE}</p>')
    gone = f'<div class="share-buttons">share</div><div class="related links">more</div><p class="advert">buy</p><div class="comments"><p>{PROSE}</p></div>'
    want = [PROSE.strip(), "cell", "found " + PROSE.strip()]
    assert density.main_text(f"<body><article>{kept}{gone}</article></body>").split("\n") == want


def test_nested_tags_take_linear_time():
    for page in ("<div>" * 100_000 + "deep", "<div>" * 30_000 + "<p>x</p>" * 30_000, "<article>" * 50_000 + "<p>y"):
        begin = time.perf_counter()
        assert density.main_text(page)
        assert time.perf_counter() - begin < 8


def test_query_against_the_articles(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id")
    found = queries.op8_main_text(spark, SF).toPandas()
    assert len(found) == len(pages)
    for row in found.itertuples():
        article = re.search(r"<article>(.*)</article>", pages.html[row.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert row.text == "\n".join(filter(None, blocks)) and row.n_chars == len(row.text) and row.url == pages.url[row.page_id]


def test_tables(spark):
    rows = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>x", 2), (1, "u", "<p>x", 2)], "page_id long, url string, html string, n_chars int")
    assert sorted((r.text, r.n_chars) for r in density.main_texts(rows).collect()) == [("", 0), ("x", 1), ("x", 1)]
    assert density.main_texts(rows.limit(0)).count() == 0
