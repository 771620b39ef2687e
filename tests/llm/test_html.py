import html as entities
import math
import random
import re

import pytest

from kvlake.llm import html as H
from kvlake.llm.html import extract, extract_text

PARAGRAPHS = ["A first paragraph with enough words to be prose, and more.", "A second one &amp; its <b>bold</b>\n  words.", "Third &eacute;tude.<br>after a break"]
WANT = ["A first paragraph with enough words to be prose, and more.", "A second one & its bold words.", "Third étude. after a break"]


def page(body, head="<title>T</title><style>p{}</style><script>var t='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


INNER = "<h1>Title</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
EXPECTED = "\n\n".join(["Title", *WANT])


@pytest.mark.parametrize(
    "body",
    [
        f"<nav><ul><li><a href='/a'>a</a></li></ul></nav><article>{INNER}</article><footer>&copy; x</footer>",
        f"<header><p>Site name and slogan words here</p></header><main>{INNER}</main><aside>Side words</aside>",
        f"<div class='wrap'><div id=sidebar><p>Lots of words in a sidebar here</p></div><div class='content'>{INNER}</div></div>",
        f"<div class='cookie-notice'>We use cookies on this site.</div><article>{INNER}<form><input><p>Sign up now</p></form><div class='comments'><p>Reader says this and that at length.</p></div></article>",
        f"<h1>Title</h1><div class='post'>{INNER.replace('<h1>Title</h1>', '')}</div><ul class='related'><li><a href=x>Other story here</a></li></ul>",
        f"<article><div class=\"ad\">Buy!</div>{INNER.replace('</p>', '')}<!-- end --></article><section id='comments'><p>{'talk ' * 300}</p></section>",
        f"<article>{INNER}<div hidden>no</div><script>if (a<b) c('</article>');</script></article>",
        f"<table><tr><td><a href=/>Home</a> <a href=/x>X</a><td>{INNER}</table>",
    ],
)
def test_articles(body):
    assert extract(page(body)) == EXPECTED


@pytest.mark.parametrize(
    "body",
    [
        f"<div class='main-notice-board'>{INNER}</div><footer>&copy; x</footer>",
        f"<nav><a href=/>Home</a></nav><div class='search-results'>{INNER}</div>",
        f"<div class='post related-entry'>{INNER}</div><div class='ad'>Buy this now.</div>",
        f"<div class='post related-entry'><h1>Title</h1><div class='widget'>{INNER.replace('<h1>Title</h1>', '')}</div></div>",
        f"<form action=/><div class='no-sidebar'>{INNER}</div></form><ul class=menu><li><a href=/>One thing</a><li><a href=/>Other thing</a></ul>",
        f"<header><p>Slogan</p></header><div>{INNER}</div><div>{'<p><a href=/a>Some other story of the day</a></p>' * 9}</div>",
        f"<div><h1>Title</h1></div><div class='body'>{INNER}</div>".replace("<div><h1>Title</h1></div>", "") + "<div class='comments'>" + "<p>I say so at some length, and so on.</p>" * 3 + "</div>",
        f"<section role='complementary'><p>{'side words ' * 8}</p></section><section>{INNER}</section>",
    ],
)
def test_misleading_names_and_pages_without_article(body):
    assert extract(page(body)) == EXPECTED


def test_nothing_of_an_article_is_dropped():
    odd = "<fieldset>A field of words.</fieldset><p><label>Labelled words.</label></p><svg><text>Drawn words.</text></svg>"
    got = extract(page(f"<article>{INNER}{odd}</article>"))
    assert got == EXPECTED + "\n\nA field of words.\n\nLabelled words.\n\nDrawn words."
    assert extract("<p>one &am<b>p;lt;</b> two, and more words</p>") == "one &amp;lt; two, and more words"
    assert extract(page(f"<article>{INNER}</article><p>{'x ' * 40}</p>".replace("<article>", "<div>").replace("</article>", "</div>"), "")).startswith(EXPECTED)
    assert extract(f"<html><head><title>T</title><div>{INNER}</div>") == EXPECTED


def brute_nodes(tree, gone):
    """(characters, tags, link characters, link tags) of each node by plain recursion."""
    out = {}

    def visit(k, linked):
        c = t = lc = lt = 0
        for x in tree.items[k]:
            if isinstance(x, str):
                c += len(x.strip())
                lc += len(x.strip()) * linked
            elif not gone[x]:
                a = visit(x, linked or tree.tag[x] == "a")
                c, t, lc, lt = c + a[0], t + a[1] + 1, lc + a[2], lt + a[3] + (linked or tree.tag[x] == "a")
        out[k] = (c, t, lc, lt)
        return out[k]

    visit(0, False)
    return out


def test_densities_and_sums_equal_brute_force():
    rng = random.Random(8)
    tags = ["div", "p", "a", "b", "section", "ul", "li", "article", "span", "td"]
    for _ in range(200):
        parts = ["<body>"]
        for _ in range(rng.randrange(60)):
            r = rng.random()
            parts.append(f"<{rng.choice(tags)}>" if r < 0.35 else f"</{rng.choice(tags)}>" if r < 0.6 else " words" * rng.randrange(1, 9))
        tree = H.Tree("".join(parts))
        gone = [False] * len(tree.tag)
        for k in range(2, len(gone)):
            gone[k] = gone[tree.parent[k]] or rng.random() < 0.05
        m, want = H.Measures(tree, gone), brute_nodes(tree, gone)
        dense = []
        for k in range(len(tree.tag)):
            if gone[k]:
                dense.append(0.0)
                continue
            c, t, lc, lt = want[k]
            inside = tree.tag[k] == "a" or any(tree.tag[x] == "a" for x in ancestors(tree, k))
            got = (m.chars[k], m.tags[k], m.link_chars[k], m.link_tags[k])
            if not inside:
                assert got[:3] == (c, t, lc)
            x = 0.0 if not c else c / max(1, t) * math.log(max(1.0001, c / max(1, m.link_chars[k]) * max(1, t) / max(1, m.link_tags[k]))) / math.log(c / max(1, c - m.link_chars[k]) * m.link_chars[k] + 0.3 * c + math.e)
            assert m.density(k, 0.3) == pytest.approx(x)
            dense.append(x)
        weights = [rng.choice([1.0, 0.2, 3.0]) for _ in tree.tag]

        def below(k, tree=tree, dense=dense, weights=weights):
            return sum(weights[x] * dense[x] if tree.tag[x] in H.BLOCK else below(x) for x in tree.items[k] if isinstance(x, int))

        assert H.sums(tree, dense, weights) == pytest.approx([below(k) for k in range(len(tree.tag))])


def ancestors(tree, k):
    while tree.parent[k] >= 0:
        k = tree.parent[k]
        yield k


def test_ties_go_to_the_later_block():
    text = "<p>Some words that are as long.</p>" * 2
    assert extract(f"<body><div>{text}</div><div>{text}</div></body>").count("Some") == 4
    tree = H.Tree(f"<body><div>{text}</div><div>{text}</div></body>")
    none = [False] * len(tree.tag)
    dense = [H.Measures(tree, none).density(k, 0.0) for k in range(len(none))]
    total = H.sums(tree, dense, [1.0] * len(none))
    assert total[2] == total[5] and max((total[k], k) for k in (2, 5))[1] == 5


def test_defined_cases():
    assert extract(None) == extract("") == extract("<html></html>") == extract("<!-- x") == ""
    assert extract("just  text") == "just text"
    assert extract(page("<article><p>1 < 2 and <b>x<p>y</article>")) == "1 < 2 and x\n\ny"
    deep = "<div>" * 5000 + "deep words" + "</div>" * 5000
    assert extract(deep) == "deep words"
    assert extract("<p>" + "word " * 200_000 + "</p>").count("word") == 200_000
    assert extract("<p a='" * 20_000 + "x") is not None


def test_fixture_pages_against_plain_patterns(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert extract(r.html) == "\n\n".join(x for x in parts if x)


def test_rows(spark):
    rows = [(1, "u", "<p>a b</p>", "x"), (1, None, None, None), (None, "u", "", 3)]
    rows = [(a, b, c, str(d)) for a, b, c, d in rows]
    out = extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string"))
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in out.collect()) == [("1", "", 0), ("1", "a b", 3), ("None", "", 0)]
    assert extract_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
