import re
from html import unescape

import numpy as np

from riskbook.llm import html_text
from riskbook.llm.html_text import extract, main_text

MENU = "<nav><ul><li><a href='/a'>Home</a><li><a href='/b'>News</a></ul></nav>"


def test_menus_adverts_notices_comments_and_forms_go():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{x:y}}</style><script>var a="</p>";</script></head><body>
    <header><h1>Site</h1></header>{MENU}<!-- ad --><div class="ad">Buy <b>now</b></div><div id="cookie-notice"><p>We use cookies</p></div>
    <article><header><h1>A &amp; B</h1></header><p>First   paragraph\nof the&nbsp;text<br>goes on.</p><aside><p>Side</p></aside><p>Of.</p>
    <form><input name=q><button>Go</button></form><p>Last <a href="#">one</a>.</p><section class="comments"><h2>Comments</h2><p>Nice!</p></section></article>
    <div class="sidebar"><p>{"Related things to read. " * 30}</p></div><footer><p>&copy; Site</p></footer></body></html>"""
    assert main_text(page) == "A & B\nFirst paragraph of the text goes on.\nOf.\nLast one."


def test_without_an_article_mark_the_longest_stretch_stays():
    body = "".join(f"<p>{'Plain sentences make up the body of this page. ' * 3}</p>" for _ in range(4))
    links = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(9))
    page = f"<body><ul>{links}</ul><div>{body}</div><ul>{links}</ul><p>© 2020</p></body>"
    assert main_text(page).split("\n") == [("Plain sentences make up the body of this page. " * 3).strip()] * 4


def test_unclosed_and_odd_markup():
    assert main_text("") == "" and main_text("just text") == "just text"
    assert main_text("<article><h1>T</h1><p><b>One<br><p>Two</article><footer>x</footer>") == "T\nOne\nTwo"
    assert main_text("<nav><a href=x>Menu</a><article><p>Body of the page</p></article>") == "Body of the page"
    assert main_text("<p class=ad>Advert<p>Real text here</p>") == "Real text here"
    assert main_text("<p>a < b and c > d") == "a < b and c > d"
    assert main_text("<article><p>x</p><script>never closed") == "x"
    assert main_text("<div><p>text <span class='ad'>advert</span></p></div>") == "text"
    assert main_text("<article>" + "<div>" * 3000 + "<p>deep</p>" + "<a href='" * 50) .startswith("deep")


def test_awkward_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<article><p>One</p></article>", None), (3, "u", "<article><p>One</p></article>", None),
            (None, "u", "<p>" + "long " * 60_000 + "</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r["page_id"], r["url"]): r["text"] for r in extract(df).collect()}
    assert got[(1, "u")] == got[(2, None)] == "" and got[(3, "u")] == "One" and len(got[(None, "u")]) == 5 * 60_000 - 1
    assert extract(df).count() == 5 and extract(df.where("false")).count() == 0


def test_articles_of_the_pages_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    for r in pages.collect():
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1])
        want = [" ".join(unescape(re.sub("<[^>]*>", "", p)).split()) for p in parts]
        assert got[r["page_id"]] == "\n".join(p for p in want if p)


def test_short_parts_and_linked_lines_of_an_unmarked_page_stay():
    body = "".join(f"<p>{'Plain sentences make up the body of this page. ' * 9}</p>" for _ in range(4))
    text = "\n".join([("Plain sentences make up the body of this page. " * 9).strip()] * 4)
    advert = "<div class='ad'><p>One</p><p>Two</p><p>Three</p></div>"
    links = "<ul><li><a href='/1'>One</a><li><a href='/2'>Two</a><li><a href='/3'>Three</a></ul>"
    for between in (advert, links):
        assert main_text(f"<p>Opening.</p>{between}<div>{body}</div>{between}<p>The end.</p>") == f"Opening.\n{text}\nThe end."
    assert main_text(f"<p>{links}<h2><a href='/x'>Headline</a></h2>{body}<ul><li><a href='/y'>Source</a><li>and more</ul>") == f"Headline\n{text}\nSource\nand more"
    assert main_text("<p>Text<p><a href='/z'>Linked end</a>") == "Text\nLinked end"


def test_names_of_wrappers_and_headings_lose_no_text():
    for name in ("has-sidebar", "no-sidebar", "withSidebar", "sidebar", "page-banner"):
        page = f"<body><div class='{name}'>{MENU}<div><p>First part of it.</p><div class='ad-box'>Buy</div><p>Second part.</p></div></div><footer>x</footer></body>"
        assert main_text(page) == "First part of it.\nSecond part.", name
    assert main_text("<h2 id='discussion'>Discussion</h2><p>Text of it</p>") == "Discussion\nText of it"
    assert main_text("<article><h2 class='related'>Related work</h2><div class='social'><p>Long text of the article</p></div></article>") == "Related work\nLong text of the article"
    assert main_text("<p>Text</p><div id='comments'><p>A comment that is longer than the text</p></div>") == "Text"
    assert main_text("<div class='promo'>Left</div><div class='notice'>Both</div><nav>Menu</nav>") == "Left\nBoth"
    assert main_text("<nav>Menu</nav>") == "Menu"


def test_surges_equal_a_scan_of_every_window():
    rng = np.random.default_rng(4)
    for _ in range(300):
        lengths = rng.integers(0, 3, rng.integers(0, 25)) * rng.integers(1, 40)
        window = int(rng.integers(1, 5))
        kept, start = [], None
        for i in range(len(lengths) + window):
            some = any(0 <= j < len(lengths) and lengths[j] for j in range(i - window + 1, i + 1))
            if some and start is None:
                start = i
            if not some and start is not None:
                kept.append((start, max(j for j in range(i) if j < len(lengths) and lengths[j]) + 1))
                start = None
        assert html_text.surges(lengths, window) == kept


def test_unmarked_pages_lose_link_lists_alone():
    rng = np.random.default_rng(5)
    for _ in range(40):
        want, page, before = [], "<html><body><div class='page'>", True
        for k in range(6):
            told = [f"Sentence {k}.{i} of the text." for i in range(rng.integers(1, 4))]
            linked = [f"Link {k}.{i}" for i in range(rng.integers(0, 6))]
            page += "".join(f"<p>{t}</p>" for t in told) + "".join(f"<div><a href='/x'>{t}</a></div>" for t in linked)
            want += told + (linked if len(linked) < 3 else [])
        assert html_text.main_text(page + "</div></body></html>").split("\n") == want


def test_hidden_is_an_attribute_not_a_word():
    page = """<article><p title="the hidden cost of it">One.</p><p class="card hidden md:block">Two.</p><p data-hidden-x=1>Three.</p><p hidden>No.</p>
    <p aria-hidden="true">No.</p><p style="color:red; display : none">No.</p><p title='display:none'>Four &amp; five.</p></article><article><p>Another article.</p></article>"""
    assert html_text.main_text(page).split("\n") == ["One.", "Two.", "Three.", "Four & five.", "Another article."]


def test_odd_markup_takes_time_in_proportion():
    import time
    for bit in ("<a ", "<b 'q ", "<b x='q ", "<b x='q > ", "<svg>", "</svg <svg>", "<!-- x ", "<p title=\"", "< <", "<![x ", "<div class='ad'>", "= ' <i a= "):
        page = bit * (1_000_000 // len(bit))
        t = time.time()
        html_text.main_text(page)
        assert time.time() - t < 10, bit
    assert html_text.main_text("<p a='x>y'>in</p> 1 < 2 <b") == "in\n1 < 2 <b"
