"""Main text extraction on layouts that no labelled page has, and on markup that isn't well formed."""

import random

import pytest

from bomatlas.llm import html_content as content

P = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do."
Q = "Ut enim ad minim veniam quis nostrud exercitation ullamco laboris."

LAYOUTS = {
    "blog": (
        '<!doctype html><html><head><title>t</title></head><body class="has-sidebar"><header class="site-header"><a href="/">Site</a>'
        '<nav id="main-menu"><a href="/a">A</a></nav></header><main id="main" class="site-main"><article class="post-12 hentry">'
        f'<header class="entry-header"><h1 class="entry-title">Title here</h1></header><div class="entry-content"><p>{P}</p>'
        f'<div class="advert-box">Buy this now friend</div><p>{Q}</p><ul><li>one item</li><li>two item</li></ul></div>'
        '<footer class="entry-footer">Posted in X</footer></article><div id="comments" class="comments-area"><article class="comment">'
        f'<p>{Q} nice post</p></article></div></main><aside class="widget-area"><p>{P}</p></aside><footer class="site-footer">2020 Site</footer></body></html>',
        f"Title here\n\n{P}\n\n{Q}\n\none item\n\ntwo item",
    ),
    "no landmarks": (
        f'<html><body><div><a href=/>Home</a> | <a href=/b>About us</a></div><h1>The Title</h1><p>{P}<p>{Q}<br>more &amp; more<div>Copyright 2021</div></body></html>',
        f"The Title\n\n{P}\n\n{Q} more & more",
    ),
    "table layout": (
        f"<table><tr><td><a href=1>one</a><br><a href=2>two</a></td><td><h1>The Title</h1><p>{P}</p><p>{Q}</p></td></tr></table>",
        f"The Title\n\n{P}\n\n{Q}",
    ),
    "form around the page": (
        f'<body><form id="f"><div class="header">Logo text</div><div id="content"><h1>The Title</h1><p>{P}</p></div><div class="footer">foot</div></form></body>',
        f"The Title\n\n{P}",
    ),
    "form around plain blocks": (f"<body><form><p>{P}</p><p>{Q}</p></form></body>", f"{P}\n\n{Q}"),
    "title outside": (
        '<body><div class="topnav"><a href=x>x</a></div><h1>The Title</h1><div class="share-buttons">Share Tweet</div>'
        f'<div class="article-content"><p>{P}</p><figure><img src=x><figcaption>A caption</figcaption></figure><p>{Q}</p></div>'
        f'<div class="related-posts"><h3>Read also</h3><a href=1>{P}</a></div><section class="comments-section"><h2>Comments</h2><p>{Q}</p></section></body>',
        f"The Title\n\n{P}\n\nA caption\n\n{Q}",
    ),
    "notice first, form inside": (
        '<body><div class="cookie-banner"><p>We use cookies to improve your experience on this site and more.</p><button>OK</button></div>'
        f'<main><h1>The Title</h1><p>{P}</p><form class="newsletter-signup"><label>Email</label><input><button>Go</button></form><p>{Q}</p></main></body>',
        f"The Title\n\n{P}\n\n{Q}",
    ),
    "script, style and a broken end": (f'<article><p>{P}</p><script>if (a < b) x("</p>")</script><style>p{{}}</style><p>{Q}', f"{P}\n\n{Q}"),
    "references and white space": (
        "<article><h2>Hi</h2><p>a<b>b</b>c &lt;x&gt;&nbsp;&nbsp;d &#233;&amp</p><pre>x  y\n\t z</pre><!-- not <p>this</p> --></article>",
        "Hi\n\nabc <x> d é&\n\nx y z",
    ),
    "odd tags": (f'<article><p title="a > b">{P}</p></p></i><p>3 < 4 and <b>{Q}</article><p clas', f"{P}\n\n3 < 4 and {Q}"),
    "upper case": (f"<BODY><NAV>menu</NAV><ARTICLE><P>{P}</P></ARTICLE></BODY>", P),
    "plain text": ("no markup  at all", "no markup at all"),
    "only a menu": ('<nav><a href="/">home</a></nav>', ""),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.fixture(scope="module")
def weights(spark):
    return content.learn(content.default_pages(spark))


@pytest.mark.parametrize("name", list(LAYOUTS))
def test_layout(weights, name):
    page, text = LAYOUTS[name]
    assert content.main_text(page, weights) == text


def test_held_out_pages(weights):
    """Pages of another seed: other words, other openings beside one another."""
    pages = content.labelled_pages(seed=5)
    right = sum(content.main_text(page, weights) == text for page, text in pages)
    assert right >= 0.95 * len(pages)


def test_weights_come_from_the_labels(spark):
    """Where the labels say that articles hold no text, articles speak against their words."""
    page = f"<div class=zone><article><p>{P}</p></article><div class=blurb><p>{Q}</p></div></div>"
    weights = content.learn(spark.createDataFrame([(page, Q)] * 8, "html string, text string"))
    assert weights.containers["article"] < 0 < weights.containers[".blurb"]
    assert content.main_text(page, weights) == Q


def test_best_run_is_the_maximum(weights):
    """The scan against all runs."""
    draw = random.Random(3)
    for _ in range(30):
        parts = ["<p>", "</p>", "<div>", "</div>", "<li>", "word " * 12, "two words", "<a href=x>", "</a>", "<h1>", "</h1>"]
        page = "".join(draw.choices(parts, k=18))
        row = content.tokens(page, weights.containers)
        marked, n = content._marked(row), content._block_words(row)

        def score(token):
            if token.tag is not None:
                return weights.tags.get(token.tag, -1.0)
            return weights.words.get(content._word_class(token, n[token.block], marked), 0.0) * len(token.text.split())

        scores = [score(t) for t in row]
        runs = [(sum(scores[a:b]), -a, -b) for a in range(len(row)) for b in range(a + 1, len(row) + 1)]
        best, a, b = max(runs, default=(0, 0, 0))
        text = "\n\n".join(t for _, t in content.blocks(row[-a:-b])) if best > 1e-9 else ""
        assert content._best_run(row, weights) == text


def test_frame(spark, weights):
    """Nulls, repeated rows, extra and clashing columns, a long page, an empty table."""
    long = "<article>" + "".join(f"<p>{i} {P}</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", f"<article><p>{P}</p></article>", "old"), (1, "u", f"<article><p>{P}</p></article>", "old"), (None, None, None, None), (2, "v", long, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = content.extracted(pages, weights).drop("html").collect()
    assert sorted([(r.page_id or 0, r.url or "", r.n_chars) for r in found]) == [(0, "", 0), (1, "u", len(P)), (1, "u", len(P)), (2, "v", len("\n\n".join(f"{i} {P}" for i in range(20_000))))]
    assert {r.text for r in found if r.page_id == 1} == {P}
    assert content.extracted(pages.limit(0), weights).count() == 0
    nothing = content.learn(spark.createDataFrame([], "html string, text string"))
    assert content.main_text(f"<p>{P}</p>", nothing) == ""
