"""The cut against brute force, pages on which it must overrule the classifier, and odd, long and hostile pages."""

import random
import time
from itertools import product

import pytest

pytest.importorskip("tessera.llm.queries")

from tessera.llm import html  # noqa: E402

LONG = "This is a sentence of the article, which goes on for a while; it has commas, and it ends here. " * 3


def price(side, source, sink, edges):
    return sum(b if s else a for s, a, b in zip(side, source, sink)) + sum(w for (a, b), w in edges.items() if side[a] != side[b])


def test_cut_against_all_labellings():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 9)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        source, sink = [max(x, 0.0) for x in odds], [max(-x, 0.0) for x in odds]
        edges = {(a, b): rng.uniform(0, 1.5) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}
        side = html.minimum_cut(n, source, sink, edges)
        assert abs(price(side, source, sink, edges) - min(price(x, source, sink, edges) for x in product((False, True), repeat=n))) < 1e-6


def taught():
    rng = random.Random(5)
    return html.fit([t for _ in range(60) for t in html.lessons(page_of(rng, ("nav", "div class=ad", "article", "footer"))[0])])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # the classifier takes a bare line for boilerplate, its neighbours don't
        (f"<div><p>{LONG}</p><div>Yes</div><p>{LONG}</p></div>", "Yes"),
        (f"<article><p>{LONG}</p><p><a href=x>see the other page there</a></p><p>{LONG}</p></article>", "see the other page there"),
    ],
)
def test_cut_relabels(page, text):
    model = taught()
    (odds, content), = [(o, c) for b, o, c in html.labelled(page, model) if b.text == text]
    assert odds < 0 and content
    assert text in html.main_text(page, model).split("\n")


@pytest.mark.parametrize("model", [html.Model(), taught], ids=["prior", "fitted"])
def test_cut_does_not_save_boilerplate(model):
    page = f"<div><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><p>{LONG}</p><div class=share><p>{LONG}</p></div><div id='comments'><p>{LONG}</p></div><p>{LONG}</p><p>&copy; 2020 me</p></div>"
    assert html.main_text(page, model() if callable(model) else model) == "\n".join([LONG.strip()] * 2)


def test_whole_block_counts():
    """A block is judged whole: what decides may come after thousands of characters."""
    (block,) = html.blocks("<p>" + "word " * 1000 + "end. And more, then; done.</p>")
    assert html.features([block])[0]["sentences"] == 1.0


@pytest.mark.parametrize("unit", ["<p>a<div class=ad>b</div>", "<div>", "<p>x, y.</p><li>z", "<b><i>t</b>", "<!-- c --><a href='x'>l</a><p>q", "<" , "&amp;&#x", "<script>1</script><p>k", "<i><div><b></i>", "<tbody>a", "<b>x</i>", "<td><p>y</table>"])
def test_hostile_pages_take_linear_time(unit):
    def seconds(n):
        begun = time.process_time()
        html.main_text(unit * n)
        return time.process_time() - begun

    seconds(500)
    assert seconds(8000) < 16 * max(seconds(1000), 0.02)


def page_of(rng, names):
    """A page and its main text. names: the elements of the menu, the notice, the text and the footer."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    paragraphs = [" ".join(sentence(rng.randrange(3, 12)) for _ in range(rng.choice((1, 1, 2, 5)))) for _ in range(rng.randrange(5, 12))]
    menu, notice, main, foot = names
    links = "".join(f"<li><a href=x>{word()}</a></li>" for _ in range(6))
    html_text = f"<{menu}><ul>{links}</ul></{menu.split()[0]}><{notice}>{sentence(5)}</{notice.split()[0]}><{main}>" + "".join(f"<p>{t}</p>" for t in paragraphs) + f"</{main.split()[0]}><{foot}>&copy; {sentence(6)}</{foot}>"
    return html_text, "\n".join(paragraphs)


def test_model_is_fitted_and_does_without_names(spark):
    rng = random.Random(3)
    named = [page_of(rng, ("nav", "div class='ad banner'", "article", "footer")) for _ in range(120)]
    df = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(named)], "page_id long, url string, html string")
    model = html.train(df)
    assert model.prices["cousins"] == html.MOST and model.weights != html.PRIOR
    assert [r["text"] for r in html.extract(df, model).orderBy("page_id").collect()] == [t for _, t in named]
    # no name or kind of element tells: texts, links and the cut must
    bare = [page_of(rng, ("div id=a1", "div class='q7 z'", "div class=k", "div")) for _ in range(60)]
    found = html.extract(spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(bare)], "page_id long, url string, html string"), model).orderBy("page_id").collect()
    assert sum(r["text"] == t for r, (_, t) in zip(found, bare)) >= 57
    assert sum(r["n_relabelled"] for r in found) > 0


def test_whole_pages_against_all_labellings():
    """blocks, features, fitted costs, edges and cut together: no labelling of a small page is cheaper."""
    rng = random.Random(8)
    model = html.fit([t for _ in range(40) for t in html.lessons(page_of(rng, ("nav", "div class=ad", "article", "footer"))[0])])
    parts = ["<p>x, y. And so on.</p>", "<div>Bare</div>", "<li><a href=1>link</a></li>", "<p>word</p>", "<nav>n</nav>", "<div class=ad>Buy. Now, please.</div>", "<article><p>In it.</p><div>t</div></article>"]
    for _ in range(60):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 8)))
        found = html.blocks(page)
        odds, edges = html.log_odds(found, model), html.smoothness(found, model)
        source, sink = [max(x, 0.0) for x in odds], [max(-x, 0.0) for x in odds]
        side = [content for _, _, content in html.labelled(page, model)]
        assert price(side, source, sink, edges) == pytest.approx(min(price(x, source, sink, edges) for x in product((False, True), repeat=len(found))))
        assert html.main_text(page, model) == "\n".join(b.text for b, c in zip(found, side) if c)


def test_nothing_to_learn_from():
    assert html.fit([]) == html.Model(html.PRIOR, html.KINDS) and html.lessons("") == [] and html.lessons("<p>no name</p>") == []
    assert html.minimum_cut(0, [], [], {}) == []


def test_odd_pages(spark):
    pages = [(1, "u", None, "x"), (2, None, "", "y"), (None, "u", "<p>One,\n two &amp; three.</p>", None), (4, "u", "<p>same, text.</p>", "x"), (4, "u", "<p>same, text.</p>", "x"), (5, "u", "<p>" + "w, " * 400_000 + "</p>", "z"), (6, "u", "plain text, without any markup. It is kept; see.", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string").withColumnRenamed("text", "TEXT").selectExpr("*", "1 AS n_chars")
    got = {(r["page_id"], r["n_chars"]): r["text"] for r in html.extract(df).collect()}
    assert html.extract(df).columns == ["page_id", "url", "text", "n_chars", "n_blocks", "n_relabelled"] and html.extract(df).count() == len(pages)
    assert got[1, 0] == got[2, 0] == "" and got[None, 17] == "One, two & three."
    assert got[5, 1_199_999] == ("w, " * 400_000).strip() and (4, 11) in got and got[6, 48].startswith("plain")
    assert html.extract(df.limit(0)).count() == 0
