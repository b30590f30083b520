import re
import time
from html import unescape

import pytest

from corvane.llm import html as H
from corvane.llm.html import extract_main_text, main_text, op2_html_extraction, path_scores
from corvane.llm.io import table


def test_article_without_its_surroundings():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a>Home</a></nav><div class='ad'>Buy, now.</div>"
        "<article><h1>A &amp; B</h1><p><b>First,  one.<br>Two<p>Third &lt;x&gt;.</article><aside>Side, bar.</aside>"
        "<div id='comments'><p>Nice one, thanks.</div><form>Name</form><footer>&copy; x</footer></body></html>"
    )
    assert main_text(page) == "A & B\nFirst, one. Two\nThird <x>."


def test_pages_without_an_article_element():
    body = "".join(f"<p>Sentence {i}, with commas, and words. It goes on.</p>" for i in range(5))
    page = f"<body class='has-sidebar'><div class='menu'><a>a</a></div><div class='post'><h2>Head</h2>{body}</div><div class='sidebar'>x</div></body>"
    assert main_text(page).split("\n")[0] == "Head" and len(main_text(page).split("\n")) == 6


def test_scripts_may_hold_tags_and_markup_may_break():
    assert main_text('<article><script>var t="</p>";</script><p>Hi there.</p></article>') == "Hi there."
    assert main_text("<p>cut <a hre") == "cut"
    assert main_text("no markup at all") == "no markup at all"
    assert main_text("<ul><li>a<li>b</ul>") == "a\nb"


def test_path_scores_prefer_long_punctuated_paths():
    s = path_scores([10, 200, 180], [0, 9, 8], [("ul", "li"), ("div", "p"), ("div", "p")], radius=0)
    assert path_scores([10, 200], [0, 9], [1, 2], [1.0, 0.01], radius=0)[2] < s[("div", "p")]
    assert s[("div", "p")] > s[("ul", "li")]


def test_nulls_empty_and_other_columns(spark):
    df = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (3, "<p>x</p>", "u")], "page_id long, html string, text string")
    assert [r.text for r in extract_main_text(df).collect()] == ["", "", "x"]
    assert extract_main_text(df.limit(0)).count() == 0


LONG, SHORT = "A long sentence, with commas, and more words, that goes on and on. " * 12, "Short one, indeed."


def test_all_parts_of_an_article_without_article_element():
    one = f"<body><div class='post'><h2>Head</h2><p>{LONG}</p><p>{SHORT}</p><p>{SHORT}</p></div></body>"
    assert main_text(one).split("\n") == ["Head", LONG.strip(), SHORT, SHORT]
    two = f"<body><div>{f'<p>{LONG}</p>' * 6}</div><div>{f'<p>{LONG}</p>' * 2}</div></body>"
    assert main_text(two).split("\n") == [LONG.strip()] * 8


def test_class_words_count_whole_and_not_on_most_of_the_text():
    for name in ("content has-sidebar", "no-comments", "related-links-off", "widget"):
        page = f"<body><div class='menu'><a>a</a></div><div class='{name}'><p>{LONG}</p><p>{LONG}</p></div><div class='sidebar'>x</div></body>"
        assert main_text(page).split("\n") == [LONG.strip()] * 2
    assert main_text(f"<article><p>{SHORT}</p></article><div class='comments'><p>{LONG}</p></div>") == SHORT
    assert main_text(f"<div class='widget'><article><p>{LONG}</p></article></div>") == LONG.strip()
    assert main_text(f"<div><p>{LONG}<span class='share'>Tell all</span></p><p>{LONG}</p></div>").split("\n") == [LONG.strip()] * 2


def test_every_page_of_the_table(spark, sf):
    """The template's article, cut out by hand: head line, paragraphs, line breaks inside blocks."""
    want = {}
    for r in table(spark, sf, "pages").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html or "", re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", inner)
        texts = [" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", b))).split()) for b in blocks]
        want[r.page_id] = "\n".join(t for t in texts if t)
    out = {r.page_id: (r.text, r.n_chars) for r in op2_html_extraction(spark, sf).collect()}
    assert out == {k: (t, len(t)) for k, t in want.items()}


def _noisy(article: bool) -> str:
    """A page whose surroundings no tag and no class word names."""
    body = f"<h2>Head</h2><p>{LONG}</p><p>{SHORT}</p><ul><li>one item</li><li>two items</li></ul><p>{LONG}</p>"
    before = "<div class='x1'><span>Mon</span> <a href='/'>Start</a></div>"
    inside = "<div class='x7'><p>Nice one.</p><p>Great!</p></div><div class='x8'><a href='/1'>One more</a> <a href='/2'>And more</a></div>"
    name = "article" if article else "div"
    return f"<body>{before}<{name}>{inside}{body}{inside}</{name}><div class='x9'>Call now.</div></body>"


@pytest.mark.parametrize("article", [True, False])
def test_path_scores_decide(article, monkeypatch):
    want = ["Head", LONG.strip(), SHORT, "one item", "two items", LONG.strip()]
    assert main_text(_noisy(article)).split("\n") == want[0 if article else 0 :]
    monkeypatch.setattr(H, "path_scores", lambda lengths, marks, paths, factors=None, **_: dict.fromkeys(paths, 1.0))
    assert main_text(_noisy(article)).split("\n") != want


def test_constant_scores_change_the_pages_of_the_table(spark, sf, monkeypatch):
    pages = [r.html for r in table(spark, sf, "pages").collect()]
    own = [main_text(p) for p in pages]
    monkeypatch.setattr(H, "path_scores", lambda lengths, marks, paths, factors=None, **_: dict.fromkeys(paths, 1.0))
    assert all(main_text(p) != t for p, t in zip(pages, own, strict=True))


def test_time_is_linear_in_nesting_and_length():
    for tag in ("div", "span", "b", "li", "section", "p"):
        begun = time.time()
        assert main_text("".join(f"<{tag}>word {i} " for i in range(8000))).count("word") == 8000
        assert time.time() - begun < 2
    begun = time.time()
    assert main_text(f"<article>{'<p>' + SHORT * 30 + '</p>' * 1}</article>" * 1 + "<div>" * 8000 + "x" + "</div>" * 8000).startswith("Short one")
    assert time.time() - begun < 2


def test_repeated_rows_and_very_long_pages(spark):
    page = f"<nav>a</nav><article>{f'<p>{LONG}</p>' * 3000}</article>"
    df = spark.createDataFrame([(1, page), (1, page), (2, None)], "page_id long, html string")
    out = [r.text for r in extract_main_text(df).collect()]
    assert out[0] == out[1] == "\n".join([LONG.strip()] * 3000) and out[2] == ""
