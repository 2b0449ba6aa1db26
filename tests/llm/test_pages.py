"""The page field against brute force, and on layouts that its training never lays out."""

import itertools
import random
import time

import numpy as np
import pytest

from priceloom.llm import pages

BODY = "<p>The first paragraph has a good many words in it, and it ends here.</p><p>The second one is there too.</p>"
TEXT = "The first paragraph has a good many words in it, and it ends here.\n\nThe second one is there too."


@pytest.mark.parametrize(
    "html",
    [
        "<html><head><title>t</title><body><article>{}",
        "<body class='has-sidebar'><article>{}</article>",
        "<form><article>{}</article></form>",
        "<section class='news-item'>{}</section>",
        "<body class='promo-page ads-on'><div class='outer'><div class='lead'>{}</div><div class='sidebar'><p>Other things to read.</p></div></div>",
        "<form id='all'><div id='nav'><a href='a'>Home</a></div><table><tr><td>{}</td></tr></table><div class='footer'>Copyright us</div></form>",
        "<center><table width='90%'><tr><td><font size='2'>{}</font></td></tr></table></center>",
        "<div class='widget-area-off'><div class='prose'>{}</div></div><div class='cookie-bar'>We keep cookies.</div>",
        "<body class='comments-open'><div class='story'>{}</div><div class='comments'><p>Nice text, thanks for that.</p></div>",
    ],
)
def test_unseen_layouts(html):
    assert pages.main_text(html.format(BODY), pages.field()) == TEXT


def test_viterbi_against_all_labelings():
    by = pages.field()
    for html, _ in pages.labelled_pages(60, seed=31):
        page = pages.Blocks().read(html)
        if not 0 < len(page.found) <= 12:
            continue
        own, got = by.scores(page), by.decode(page)
        value = lambda labels: sum(s for s, x in zip(own, labels) if x) + sum(by.pairs[a][b] for a, b in itertools.pairwise(labels))  # noqa: E731, B023
        assert value(got) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=len(own)))))


def test_scores_of_deep_and_shallow_pages_are_sums_over_distinct_features():
    by = pages.field()
    made = [h for h, _ in pages.labelled_pages(40, seed=8)] + ["x<div class=a>y<div class=a>z</div>w</div>v<p>u", "<ul><li>a<ul><li>b</ul><li>c</ul>d"]
    for html in made:
        page = pages.Blocks().read(html)
        wide = page.wide()
        want = [sum(by.weights.get(f, 0.0) for f in [*pages.path_features(page, wide, n), *pages.text_features(t, k)]) for t, k, n in page.found]
        assert by.scores(page) == pytest.approx(want)


def test_slope_against_finite_differences():
    data = pages.Labelled(pages.labelled_pages(12, seed=3))
    rng = np.random.default_rng(1)
    weights = rng.normal(0, 0.3, len(data.names) + 4)
    _, slope = data.objective(weights, 1e-3)
    for k in [*rng.integers(0, len(weights), 12), *range(len(weights) - 4, len(weights))]:
        step = np.zeros_like(weights)
        step[k] = 1e-5
        assert slope[k] == pytest.approx((data.objective(weights + step, 1e-3)[0] - data.objective(weights - step, 1e-3)[0]) / 2e-5, abs=1e-6)


PARTS = ["<div>x", "<div class='a b'>x</b></i></p>", "<b><i>x<p>", "<svg><g>", "<title>x", "<p>a&amp;b</p>", "<a ", "<a b='", '<p a="', "<!--", "<title", "<title>", "<script ", "<![", "<!", "</", "<", "<?", "&", "<x-y>", "<button>", "<select>", "<template>", "<math><mi>", "<svg><![CDATA[", "</title ", "<textarea>"]


@pytest.mark.parametrize("part", PARTS)
def test_work_grows_with_the_page_only(part):
    by = pages.field()
    began = time.time()
    assert pages.main_text(part * 100_000, by) is not None
    assert time.time() - began < 10


def test_no_page_is_an_error():
    by, rng = pages.field(), random.Random(5)
    bits = [*PARTS, "</p>", "]]>", "-->", ">", "/>", "=", "'", '"', " ", "a", "</select>", "<option>", "<li>", "é", "\x00", "&#", "&lt", "![ endif]", "%entity;[", "</svg>", "<a href='"]
    for _ in range(20_000):
        assert pages.main_text("".join(rng.choice(bits) for _ in range(rng.randint(1, 40))), by) is not None


#: Markup that no text and no border of a block comes from.
MARKS = ("<script>var a = '<p>';</script>", "<style>p{}</style>", "<svg class='i'><title>t</title><path d=''/></svg>", "<!-- x > y -->", "<![endif]>", "<img src=x alt='a > b'>", "<input name=q>", "<iframe src=x>none</iframe>", "<noscript><img></noscript>", "<template><div>no</div></template>", "<wbr>", "<select><option>a<option>b</select>", "<textarea>t</textarea>", "<? php ?>", "<b></b>", "</aside>")


def laid_out(rng):
    """A page and the texts of its blocks, known from how it is made."""
    html, want = [], []
    for _ in range(rng.randint(0, 8)):
        tag = rng.choice(("p", "div", "h2", "li", "blockquote", "td", "section", "dd", "figcaption"))
        words, inner = [], []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            word = rng.choice(("one", "zwei", "a &lt; b", "x&amp;y", "1 < 2", "ñ"))
            if kind < 0.4:
                inner.append(f"{word} ")
                words.append(word)
            elif kind < 0.6:
                around = rng.choice(("b", "i", "a href='x'", "span class='c > d'", "my-icon", "button", "em", "video", "object"))
                if words:
                    inner.append(f"<{around}>{word}</{around.split()[0]}> ")
                    words.append(word)
            else:
                inner.append(rng.choice(MARKS))
        html.append(rng.choice(("", "\n", rng.choice(MARKS))) + f"<{tag}>{''.join(inner)}</{tag}>")
        if words:
            want.append(" ".join(words).replace("&lt;", "<").replace("&amp;", "&"))
    return "<body>" + "".join(html), want


def test_blocks_of_pages_whose_blocks_are_known():
    rng = random.Random(4)
    for _ in range(3000):
        html, want = laid_out(rng)
        assert [b[0] for b in pages.Blocks().read(html).found] == want, html


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>x</p><![ endif]--><p>y</p>", ["x", "y"]),
        ("<p>a <!-- never closed <p>b", ["a"]),
        ("<p>a<!-->b<!--->c", ["abc"]),
        ("<p>a <b title='never closed>b</b>", ["a"]),
        ("<p>a</p><p title=\"1 > 0\" x='<p>'>b", ["a", "b"]),
        ("<svg><text>label</text></svg><math><![CDATA[a<b]]></math>", ["a<b"]),
        ("<p>a <video src=x>no video</video> b", ["a no video b"]),
        ("<script>if (a < b) {}", []),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", ["a", "b", "c", "d"]),
    ],
)
def test_markup_as_browsers_read_it(html, want):
    assert [b[0] for b in pages.Blocks().read(html).found] == want


def test_odd_tables(spark):
    rows = spark.createDataFrame([(1, "u", None, "a", "b"), (None, None, "<p>x y.</p>", "a", "b"), (None, None, "<p>x y.</p>", "a", "b"), (2, "v", "", "a", "b")], "page_id long, url string, html string, text string, n_chars string")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in pages.extract(rows).collect())
    assert got == [(0, "", "x y.", 4), (0, "", "x y.", 4), (1, "u", "", 0), (2, "v", "", 0)]
    assert pages.extract(rows.limit(0)).collect() == []
