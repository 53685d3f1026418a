import html
import random
import re

import numpy as np
import pytest

from tekstra.llm import html_extract as h


@pytest.fixture(scope="module")
def trees():
    return h.trained()


def article(page):
    """The blocks of a fixture page's article, read by plain patterns."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x)))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(x for x in parts if x)


def test_fixture_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = h.op4(pages).collect()
    want = {r.page_id: article(r.html) for r in pages.collect()}
    assert len(found) == len(want) and all(r.n_chars == len(r.text) for r in found)
    assert sum(r.text == want[r.page_id] for r in found) >= 0.98 * len(want)


def test_held_out_generated_pages(trees):
    x, y = h.training(80, 424242)
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.98
    rng, whole = random.Random(99), 0
    for _ in range(60):
        page = h.made_page(rng)
        nodes, texts = h.blocks(h.parse(page))
        whole += h.extracted([page], trees)[0] == "\n\n".join(t for n, t in zip(nodes, texts, strict=True) if t and n.label == 1)
    assert whole >= 50


def test_decoding_is_consistent_and_best():
    rng = np.random.default_rng(0)
    for _ in range(200):
        nodes = [h.Node("#root", None)]
        for _ in range(6):
            parent = nodes[rng.integers(len(nodes))]
            nodes.append(h.Node("div", parent))
        p = rng.random(len(nodes))
        kept = h.decoded(nodes, p.copy())
        best, choice = -1e9, None
        for code in range(1 << (len(nodes) - 1)):
            k = [True] + [bool(code >> i & 1) for i in range(len(nodes) - 1)]
            if any(k[i] and not k[nodes.index(nodes[i].parent)] for i in range(1, len(nodes))):
                continue
            value = sum(np.log(p[i] if k[i] else 1 - p[i]) for i in range(1, len(nodes)))
            if value > best:
                best, choice = value, k
        assert kept == choice


@pytest.mark.parametrize(
    "page,texts",
    [
        ("<p>a &amp; b&nbsp;c <!-- x > y --><b>d\n e</b></p>", ["a & b c d e"]),
        ("<p>one<p>two<div>three</div>four", ["one", "two", "three", "four"]),
        ("<ul><li>a<li>b</ul>tail", ["a", "b", "tail"]),
        ("<script>if (a<b) x='</p>';</script><style>p{}</style>x<br>y", ["x y"]),
        ("plain text alone", ["plain text alone"]),
        ("", []),
        ("<p title='a>b'>q</p><hr>r", ["q", "r"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("<p>unclosed <a href=x>link", ["unclosed link"]),
        ("a < b &lt; c &#x41;", ["a < b < c A"]),
    ],
)
def test_parsing(page, texts):
    nodes, found = h.blocks(h.parse(page))
    assert [t for t in found if t] == texts


def test_odd_pages(spark, trees):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>only a paragraph of some words, and some more of them.</p>"), (4, "u", "<b>" * 20_000), (5, "u", "<div>" * 3000 + "deep"), (6, "u", "<p>" + "long text, really. " * 20_000), (6, "u", "<!--")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    found = h.op4(pages).collect()
    assert len(found) == 7 and all(r.text is not None for r in found)
    assert h.op4(pages.limit(0)).count() == 0


ARTICLE = "<article><h1>A title of some words</h1><p>The first paragraph has quite a few words, and a comma.</p><p>The second one has some more words, so that it reads as text.</p></article>"
TEXT = "A title of some words\n\nThe first paragraph has quite a few words, and a comma.\n\nThe second one has some more words, so that it reads as text."


def framed(article, before=""):
    return f"<html><head><title>t</title></head><body><nav class=nav><ul><li><a href=/>Home</a><li><a href=/b>More</a></ul></nav>{before}{article}<footer>&copy; someone</footer></body></html>"


def test_attributes_of_real_pages_are_no_labels_and_quotes_open_strings_only_at_a_value(spark, trees):
    assert h.extracted([framed(ARTICLE)], trees) == [TEXT]
    for start in ('<article data-main="app">', "<article data-main>", "<article data-main=0>", '<article id=x">', "<article title=don't>", '<article "stray">', "<article class=a'b id=c>", "<article =x>", "<article a = 'x>y' b>"):
        assert h.extracted([framed(ARTICLE.replace("<article>", start))], trees) == [TEXT], start
    one = ARTICLE.replace("<p>The first", '<p class=foo">The first').replace("<p>The second", '<p id="b">The second')
    pages = spark.createDataFrame([(1, "u", framed(one)), (2, "u", framed(ARTICLE.replace("<article>", '<article data-main="app">')))], "page_id long, url string, html string")
    assert [r.text for r in h.op4(pages).collect()] == [TEXT, TEXT]


@pytest.mark.parametrize("tag", ["b", "div", "span", "p><div"])
@pytest.mark.parametrize("n", [3, 450, 50_000])
def test_any_number_of_open_elements(trees, tag, n):
    nav = f'<div class="nav">{f"<{tag}>" * n}menu</div>'
    root = h.parse(framed(ARTICLE, nav.replace("</div>", "</section>").replace('<div class="nav">', '<section class="nav">')))
    stack = [root]
    while stack and (x := stack.pop()).tag != "article":
        stack += x.children
    assert x.tag == "article" and x.parent.tag == "body"


def test_a_menu_of_many_open_elements_costs_no_article(trees):
    for n in (3, 450, 5_000):
        assert h.extracted([framed(ARTICLE, f'<div class="nav">{"<b>" * n}menu</div>')], trees) == [TEXT], n


def test_long_articles_with_things_between(trees):
    """Siblings are counted over all of them; adverts and notices among hundreds of paragraphs go, the paragraphs stay."""
    words = "the quick brown fox jumps over a lazy dog, and then it sleeps in the sun all day long.".split()
    rng = random.Random(2)
    for n in (20, 63, 64, 65, 130, 300):
        paras = ["".join(f"{w} " for w in rng.choices(words, k=rng.randint(12, 40))).strip() for _ in range(n)]
        inner = [f"<p>{x}</p>" for x in paras]
        inner.insert(n // 2, '<div class="ad">buy this now</div>')
        inner.insert(n // 3, '<div class="cookie-notice">we use cookies <button>ok</button></div>')
        assert h.extracted([framed("<article><h1>A title of words</h1>" + "".join(inner) + "</article>")], trees) == ["\n\n".join(["A title of words", *paras])], n


def plain_features(nodes, texts):
    """Each feature from its own definition, by walking the tree anew for every node."""

    def under(x):
        return [x, *(z for y in x.children for z in under(y))]

    text = {id(x): t for x, t in zip(nodes, texts, strict=True)}
    chars = lambda x: sum(len(text[id(y)] or "") for y in under(x))
    links = lambda x: sum(min(y.links, len(text[id(y)])) for y in under(x) if text[id(y)])
    total, out = max(1, chars(nodes[0])), []
    for i, x in enumerate(nodes):
        above, up = [], x.parent
        while up is not None:
            above.append(up)
            up = up.parent
        own, c = under(x), max(1, chars(x))
        held = [text[id(y)] for y in own if text[id(y)]]
        words, stops = sum(t.count(" ") + 1 for t in held), sum(len(re.findall("[.,?!]", t)) for t in held)
        sib = x.parent.children if x.parent else [x]
        at = next(k for k, y in enumerate(sib) if y is x)
        kind = [0.0] * h.N_TAGS
        kind[h._TAGS.get(x.tag, 0)] = 1
        parent = chars(x.parent) if x.parent else c
        row = [len(above), np.log1p(chars(x)), np.log1p(words), links(x) / c, chars(x) / sum(y.tags + 1 for y in own), stops / c * 100, np.log1p(stops), chars(x) / max(1, words), chars(x) / max(1, len(held)), sum(len(t) > 120 for t in held), sum(y.tag == "p" for y in own), chars(x) / total, sum(len(t) for t in texts[:i] if t) / total, x.good, x.bad, sum(y.good for y in above), sum(y.bad for y in above), at, len(sib), sum(y.tag == x.tag for y in sib) / len(sib), chars(x) / max(1, parent), np.log1p(chars(sib[at - 1])) if at else -1, np.log1p(chars(sib[at + 1])) if at + 1 < len(sib) else -1, links(x.parent) / max(1, chars(x.parent)) if x.parent else 0, h._TAGS.get(x.parent.tag, 0) if x.parent else 0, np.log1p(total)]
        out.append(kind + row)
    return np.array(out, np.float32)


def test_features_equal_their_definitions():
    rng = random.Random(12)
    for _ in range(12):
        nodes, texts = h.blocks(h.parse(h.made_page(rng)))
        if len(nodes) < 150:
            assert np.allclose(h.featured(nodes, texts), plain_features(nodes, texts), rtol=1e-4, atol=1e-4)


def test_trees_equal_walks_and_split_best():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    y = (x[:, 1] + 0.3 * x[:, 3] > 0.2).astype(np.float64)
    trees = h.Trees(rounds=6, depth=3, bins=8).fit(x, y)
    p = trees.probability(x)
    for row, got in zip(x, p, strict=True):
        score = trees.start
        for r in range(trees.rounds):
            node = 1
            for _ in range(trees.depth):
                f = trees.feature[r, node]
                node = 2 * node + (int(np.sum(trees.edges[f] < row[f])) > trees.cut[r, node])
            score += trees.value[r, node - 8]
        assert abs(1 / (1 + np.exp(-score)) - got) < 1e-12
    # The first split is the best of all, tried one by one.
    q = 1 / (1 + np.exp(-trees.start))
    g, w, best = y - q, np.full(len(y), q * (1 - q) + 1e-9), (-1.0, None)
    for f in range(5):
        places = np.searchsorted(trees.edges[f], x[:, f], side="left")
        for cut in range(7):
            left = places <= cut
            if min(w[left].sum(), w[~left].sum()) >= 1:
                best = max(best, (g[left].sum() ** 2 / (w[left].sum() + 2) + g[~left].sum() ** 2 / (w[~left].sum() + 2), (f, cut)))
    assert (trees.feature[0, 1], trees.cut[0, 1]) == best[1]
    assert ((p > 0.5) == y).mean() > 0.9
