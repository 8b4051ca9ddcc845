import pytest
from pyspark.sql import functions as F

from sparkomics.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var t="</p>";</script></head><body class="single-post">
<header><a href=/>Home</a> The site</header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="cookie-banner">We use cookies. <button>OK</button></div>
<!-- <p>no</p> --><aside><p>Side <p>bar</aside><article><h1>Title &amp; more</h1><p>First  para &lt;with&gt;\n<a href="x?a=1>2">a link</a> and words enough&nbsp;to be text.<p>Second para<br>continues &eacute; &#233; &#x1F600;.
<form><input>Search<button>go</button></form><div class="ad">Buy this now.</div><p>Third, final para of it.</p><section class="comments"><h2>Comments</h2><p>I liked it a lot, thanks.</p></section></article>
<footer>&copy; 2020 us. All rights.</footer></body></html>"""
TEXT = "Title & more\n\nFirst para <with> a link and words enough to be text.\n\nSecond para continues é é 😀.\n\nThird, final para of it."


def test_article_without_furniture():
    assert H.extract(PAGE, H.train()) == TEXT


def test_tree_fits_its_table():
    tree, rows = H.train(), H.labelled(H.LABELLED)
    assert len(rows) > 100 and sum(H.is_content(tree, r[:-1]) == bool(r[-1]) for r in rows) / len(rows) > 0.97


def test_tree_on_pages_that_it_has_not_seen():
    """Each labelled page told by a tree of the others."""
    right = total = 0
    for i, page in enumerate(H.LABELLED):
        tree = H.train(H.LABELLED[:i] + H.LABELLED[i + 1 :])
        rows = H.labelled([page])
        right, total = right + sum(H.is_content(tree, r[:-1]) == bool(r[-1]) for r in rows), total + len(rows)
    assert right / total > 0.85


PARAGRAPHS = ["The harbour was quiet when the boats came in that night.", "Nobody had seen them leave, and nobody asked.", "So it went on for years, until the war."]


@pytest.mark.parametrize("around", ['<div class="content has-sidebar">', '<article class="post no-comments">', '<article data-role="search">', '<article class="article-meta-2024">', "<article>", f'<article data-x="{"a>" * 5000}">'])
def test_what_stays_in_an_article(around):
    more = ["They left for good.", "See the long report of the harbour master for all that is known.", "Then x = 2 holds.", "Inside out."]
    said = [*PARAGRAPHS, f"<a href=x>{more[1][:-28]}</a>{more[1][-28:]}", "Then <math><mi>x</mi> = 2</math> holds.", "<object>Inside</object> out.", more[0]]
    page = f"<body><nav><a href=a>Home</a></nav>{around}{''.join(f'<p>{p}</p>' for p in said)}</{around[1:].split()[0].strip('>')}><footer>Us. All rights.</footer></body>"
    assert H.extract(page, H.train()).split("\n\n") == [*PARAGRAPHS, *more[1:], more[0]]


def test_plain_paragraphs_without_hints():
    page = "<body><div><a href=a>One</a> <a href=b>Two</a></div><div>" + "".join(f"<p>Sentence number {i} is long enough to count as one of the text.</p>" for i in range(5)) + "</div></body>"
    assert H.extract(page, H.train()).count("Sentence") == 5 and "One" not in H.extract(page, H.train())


@pytest.mark.parametrize("open_tag", ['section class="social-history"', 'div class="survey-results"', 'div id="search-content"', 'div class="notice-board-history"', 'div id="form-and-function"', 'div class="survey"', "article><!--", "article><!---"])
def test_classes_that_only_sound_like_furniture(open_tag):
    paragraphs = [f"Paragraph {i} tells at some length how the matter went on, who had a part in it, and what came of it in the end." for i in range(3)]
    page = f"<body><nav><a href=a>Home</a></nav><{open_tag}>{''.join(f'<p>{p}</p>' for p in paragraphs)}</{open_tag.split()[0].split('>')[0]}><footer>Us. All rights.</footer></body>"
    assert H.extract(page, H.train()).split("\n\n") == paragraphs


def test_short_paragraphs_beside_long_ones():
    long = "It was made in the valley by a family that had done so for as long as anybody there could remember, and they sold it to nobody."
    page = f"<nav><a href=/>Home</a></nav><div><h1>A cheese</h1><p>{long}</p><p class=\"meta-analysis\">A study of it found little.</p><p>By hand.</p><p>Done</p></div><footer>Us.</footer>"
    assert H.extract(page, H.train()).split("\n\n") == ["A cheese", long, "A study of it found little.", "By hand.", "Done"]


@pytest.mark.parametrize("around", ['div class="related-articles"', 'div class="comment-list"', 'section id="comments-section"', 'div class="newsletter-box"', 'div class="ad-slot-2"', "aside", "footer"])
def test_furniture_beside_an_article(around):
    tag = around.split()[0]
    page = f"<article><p>{PARAGRAPHS[0]}</p><p>{PARAGRAPHS[1]}</p></article><{around}><p>There is more to read here, and it is as long as any paragraph of the article itself.</p></{tag}>"
    assert H.extract(page, H.train()).split("\n\n") == PARAGRAPHS[:2]


def test_broken_markup_ends():
    tree = H.train()
    for page in ("", "<", "<p", "<p class='x", "<!-- never", "<script>never", "a < b > c", "</p></div></html>", "<a" * 20_000, "&" * 1000, "<p>" * 5000 + "x", "<p title=\"'" * 3000, "<p title=\"a>" * 100_001, "<p title='\">" * 100_001):
        assert isinstance(H.extract(page, tree), str)


def test_query_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<article><p>" + "long text. " * 50_000 + "</article>")], "page_id long, url string, html string")
    out = H.main_text(df.withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(0)))
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in out.collect()}
    assert out.count() == 5 and got[1, "u"] == (TEXT, len(TEXT)) and got[2, None] == ("", 0) and got[None, "v"] == ("", 0)
    assert got[3, "w"][1] == 50_000 * 11 - 1
    assert H.main_text(df.limit(0)).count() == 0
