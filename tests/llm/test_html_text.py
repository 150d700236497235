import random

import pytest

from cohortlens.llm.html_text import Weights, best_run, extract, extract_text, learn_weights, tokens

ARTICLE = ("Big title", "Para one & two with bold word.", "item one", "item two", "More text after break", "last para of the story")
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style></head><body>
<header class="site-header"><a href="/">Home page</a></header><nav><ul><li><a href=x>News of today</a></li></ul></nav>
<div class="sidebar"><p>Side words here and there and more of them</p></div><div class="cookie-notice">We use cookies for this site</div>
<div id="content"><h1>Big title</h1><p>Para one &amp; two   with <b>bold</b>
word.<ul><li>item one<li>item two</ul><script>if (a < b) {"</p>"}</script><p>More text<br>after break
<aside><p>aside text goes here</p></aside><div class="ad">Buy these things now</div><form><label>Name</label><input></form>
<p>last para of the story</div><section class="comments"><p>first! great post, a comment by a reader</p></section>
<footer><p>&copy; 2020 the publisher</p></footer></body></html>"""


def dynamic_best(scores):
    """The greatest sum of a contiguous run, by trying all of them."""
    return max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)


@pytest.mark.parametrize("seed", range(60))
def test_the_linear_scan_finds_the_greatest_sum(seed):
    rng = random.Random(seed)
    gains = [rng.choice([-2.0, -0.5, 0.0, 0.5, 1.0, 3.0]) for _ in range(rng.randint(0, 40))]
    best, start, stop = best_run(gains)
    assert best == dynamic_best(gains) == sum(gains[start:stop])


def test_article_without_what_surrounds_it():
    assert extract(PAGE, Weights({})) == "\n\n".join(ARTICLE)


@pytest.mark.parametrize("seed", range(30))
def test_the_run_has_the_greatest_sum(seed):
    """The extracted words are those of a run that no other run beats."""
    rng = random.Random(seed)
    parts = ["<p>", "</p>", "<nav>", "</nav>", "<div>", "</div>", "<li>", "w " * 3, "v v ", "u ", "<br>"]
    page = "".join(rng.choices(parts, k=30))
    weights = Weights({"tag p": (5, 1), "tag /p": (5, 1), "tag nav": (0, 9), "tag li": (1, 4), "in div": (3, 3), "in nav": (0, 9)})
    scores, gains = [], []
    for kind, value, containers, _ in tokens(page):
        gain = weights.tag(value) if kind else weights.chain(containers) * len(value.split())
        scores.append(gain)
        if not kind and weights.chain(containers) >= 0.5:
            gains.append(len(value.split()))
    found = extract(page, weights).split()
    assert len(found) <= sum(gains)
    assert bool(found) <= (dynamic_best(scores) > 0)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<", "<"),
        ("<p", ""),
        ("<!-- open", ""),
        ("<script>x", ""),
        ("plain words only", "plain words only"),
        ("<p>a<p>b<b", "a\n\nb"),
        ("<p>a &lt;b&gt; &eacute;&#233;&nbsp;c</p>", "a <b> éé c"),
        ("<p>one<br>two</p><p> </p><p>three</p>", "one two\n\nthree"),
        ("<p>x <button>Buy</button> y</p>", "x y"),
        ("<p>see <svg><path d='M0'/><text>no</text></svg>the <select><option>a</select> sign</p><p>next</p>", "see the sign\n\nnext"),
    ],
)
def test_odd_markup(page, text):
    assert extract(page, Weights({})) == text


def test_weights_follow_labelled_pages(spark):
    pages = [(i, f'<body><div class="zone{i % 2}">menu words</div><article><h1>t{i}</h1><p>some content words here</p></article><em>x</em></body>', "own") for i in range(20)]
    pages += [(50, "<body><p>no label</p></body>", "own"), (51, None, "own"), (None, "<article>x</article>", "own")]
    table = spark.createDataFrame(pages, "page_id long, html string, text string")
    counts = learn_weights(table)
    weights = Weights(counts)
    assert weights.tag("div.zone0") < weights.tag("p") < 0
    assert weights.chain(("body", "div.zone1")) < 0.5 < weights.chain(("body", "article", "p"))
    got = {r["page_id"]: r["text"] for r in extract_text(table, counts).collect()}
    assert got[3] == "t3\n\nsome content words here" and got[51] == "" and len(got) == 23
    assert extract_text(table.limit(0), counts).count() == 0


def test_very_long_page(spark):
    body = "".join(f"<p>paragraph number {i} of a long page</p>" for i in range(20_000))
    page = spark.createDataFrame([(1, f"<nav><a>menu</a></nav><article>{body}</article>")], "page_id long, html string")
    text = extract_text(page, {}).first()["text"]
    assert text.count("\n\n") == 19_999 and text.startswith("paragraph number 0")


def test_lists_and_links_in_articles_stay_when_labelled_articles_have_none(spark):
    menu = "<nav><ul>" + '<li><a href="/x">menu entry words</a></li>' * 40 + "</ul></nav>"
    tail = "<div><ul>" + '<li><a class="more" href="/y">other story</a></li>' * 10 + "</ul></div><footer><a href=z>about us</a></footer>"
    page = "<body><header><a href=/>Home</a></header>" + menu + "<article><h1>t</h1>{}</article>" + tail + "</body>"
    labelled = [(i, page.format("<p>some plain words without any link in them</p>" * 5)) for i in range(200)]
    story = (
        "<header><p>By a writer</p></header><p>Before it.</p><p>See <a class=more href=u>the linked page</a> for it.</p>"
        "<ul><li>first thing</li><li>the <a href=v>second</a> thing</li></ul><section><p>After it.</p></section>"
    )
    want = ["t", "By a writer", "Before it.", "See the linked page for it.", "first thing", "the second thing", "After it."]
    weights = Weights(learn_weights(spark.createDataFrame(labelled, "page_id long, html string")))
    assert extract(page.format(story), weights) == "\n\n".join(want)
    other = page.replace("<article>", '<div id="text">').replace("</article>", "</div>")
    assert extract(other.format(story), weights) == "\n\n".join(want)
