import itertools
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from barloom.llm import html_extract
from barloom.llm.labelled_pages import PAGES, _page
from tests.llm import fresh_layouts, unseen_layouts

SCHEMA = "page_id long, url string, html string"
BODY = ["The council met on Tuesday and agreed to repair the harbour wall.", "Work begins in spring, if the weather allows it.", "Nobody spoke against the plan."]


@pytest.fixture(scope="module")
def model():
    return html_extract.Model.fit(PAGES)


def page(main, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script><style>p{{}}</style></head><body>{before}{main}{after}</body></html>"


MAIN = "".join(f"<p>{t}</p>" for t in BODY)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (page(f"<article><h1>Harbour wall</h1>{MAIN}</article>", '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav><div class="ad">Buy two boats and pay for one of them only.</div>', "<footer>&copy; 2024 Gazette</footer>"), ["Harbour wall", *BODY]),
        (page(f'<div class="content">{MAIN}</div>', '<header><p>The Gazette of the harbour.</p></header><div class="cookie-banner"><p>We use cookies to make this better for you.</p></div>', '<div class="sidebar"><ul><li><a href="/a">Other news of the week</a></li></ul></div>'), BODY),
        (page(f"<main>{MAIN}<section id='comments'><p>I was there and it was loud.</p><p>Me too, and I agree with that.</p></section></main>", after="<aside><p>More of this tomorrow.</p></aside>"), BODY),
        (page(f"<article>{MAIN}</article>", after='<form action="/s"><p>Sign up for our letter.</p><input><button>Go</button></form><div class="advertisement"><p>A sponsored word about paint and varnish.</p></div>'), BODY),
        (page(f"<article><p><b>{BODY[0]}<br><p>{BODY[1]}<p>{BODY[2]}</article>"), BODY),
        ("<article><p>Fish &amp; chips &eacute;&nbsp;\n\t now &#8364;5</p><p>Second", ["Fish & chips é now €5", "Second"]),
        ("<article><p>Whole text here, and more of it.</p><p>Cut off in a tag <a href='x", ["Whole text here, and more of it.", "Cut off in a tag"]),
        ("<article><p>a < b and c > d, always so.</p><!-- gone --><p>x<script>no()</script>y</p></article>", ["a < b and c > d, always so.", "xy"]),
        ("", []),
        (None, []),
        (page('<nav><a href="/">Home</a><a href="/x">Next</a></nav>'), []),
    ],
)
def test_main_text(model, html, want):
    assert model.texts([html])[0] == "\n".join(want)


@pytest.mark.parametrize(
    "html",
    [
        f"<head><title>x</title><body><article>{MAIN}</article>",
        f"<html><head><meta charset=utf-8><title>x</title><style>p{{}}</style><article>{MAIN}</article>",
        f"<head><template><p>Not a part of the page, this one.</p></template><link rel=x><body><article>{MAIN}</article>",
        f"<html><head><head><title>x</title></body><body class=page><article>{MAIN}</article></html>",
        f"<article><p title=it's>{BODY[0]}</p><p>{BODY[1]}</p><p title=it's>{BODY[2]}</p></article>",
        f'<article><p id="x"">{BODY[0]}</p><p>{BODY[1]}</p><p id="y"">{BODY[2]}</p></article>',
        f'<article><p title=/s?q="x>{BODY[0]}</p><p \'>{BODY[1]}</p><p ">{BODY[2]}</p></article>',
        f"<article><p title = 'a > b'>{BODY[0]}</p><p title=\"a > 'b\" id=>{BODY[1]}</p><p a='x'b=\">\"/>{BODY[2]}</article>",
    ],
)
def test_open_heads_and_stray_quotes(model, html):
    assert model.texts([html])[0] == "\n".join(BODY)


def test_text_closes_an_open_head():
    assert [t for t in html_extract.Tree("<head>\n<title>x</title>\nOut <b>of</b> it<meta>").text if t] == ["\nOut ", "of", " it"]


def test_labelled_pages_are_told_apart(model):
    wrong = total = 0
    trees = [html_extract.Tree(p) for p in PAGES]
    for tree, chance in zip(trees, model.marginals(trees)):
        for v, y in enumerate(tree.labels()):
            if tree.text[v] is not None and tree.text[v].strip():
                total += 1
                wrong += (chance[v] >= 0.5) != (y >= 0.5)
    assert wrong <= 0.01 * total


def test_training_generalises_to_pages_left_out():
    model = html_extract.Model.fit([p for k, p in enumerate(PAGES) if k % 7])
    left = [html_extract.Tree(p) for p in PAGES[::7]]
    right = [(c[v] >= 0.5) == (y >= 0.5) for t, c in zip(left, model.marginals(left)) for v, y in enumerate(t.labels()) if t.text[v] is not None and t.text[v].strip()]
    assert np.mean(right) > 0.9


def right(model, pages):
    trees = [html_extract.Tree(p) for p in pages]
    return np.mean([(c[v] >= 0.5) == (y >= 0.5) for t, c in zip(trees, model.marginals(trees)) for v, y in enumerate(t.labels()) if t.text[v] is not None and t.text[v].strip()])


def test_training_generalises_to_layouts_left_out():
    """Each of the ten hand-written layouts in turn is left out with all its pages."""
    scores = []
    for held in range(10):
        own = [p for k in range(3) for n, p in enumerate(_page(k)) if n == held]
        rest = [p for k in range(3) for n, p in enumerate(_page(k)) if n != held] + PAGES[60::3]
        scores.append(right(html_extract.Model.fit(rest), own))
    assert np.mean(scores) >= 0.8, scores


def test_training_without_any_words(monkeypatch):
    """By tags, lengths and links alone, with the words of classes, ids, roles and texts unknown."""
    full = right(html_extract.Model.fit([p for k, p in enumerate(PAGES) if k % 7]), PAGES[::7])
    monkeypatch.setattr(html_extract, "_CUES", re.compile(r"(?!)"))
    monkeypatch.setattr(html_extract, "_ATTR", re.compile(r"(?!)"))
    score = right(html_extract.Model.fit([p for k, p in enumerate(PAGES) if k % 7]), PAGES[::7])
    assert 0.6 < score <= full, (score, full)


def test_long_pages_are_taken_few_at_a_time():
    taken = [(start, len(part)) for start, part in html_extract.bodies(pa.array(["x" * 3_000_000] * 5 + ["y"] * 100), 64)]
    assert taken[:2] == [(0, 2), (2, 2)] and max(n for _, n in taken) <= 64


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(1)
    tree = html_extract.Tree("<div><p>a<b>b</b></p><ul><li>c</li></ul></div>d")
    forest = html_extract.Forest([tree])
    own, joint = rng.normal(size=len(tree.parent)), rng.normal(size=(2, 2, 2))
    n, total, mass, pairs = len(own), 0.0, np.zeros(len(own)), np.zeros((len(own), 2, 2))
    for states in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(own[v] * s for v, s in enumerate(states)) + sum(joint[forest.piece[v], states[p], states[v]] for v, p in enumerate(tree.parent) if p >= 0))
        total += w
        mass += w * np.array(states)
        for v, p in enumerate(tree.parent):
            if p >= 0:
                pairs[v, states[p], states[v]] += w
    chance, edge = forest.pass_messages(own, joint)
    assert np.allclose(chance, mass / total) and np.allclose(edge[1:], pairs[1:] / total)


def test_extract_table(spark):
    long = "<article>" + "".join(f"<p>{BODY[k % 3]} {k}</p>" for k in range(5000)) + "</article>"
    rows = [(1, "u", page(MAIN)), (1, "u", page(MAIN)), (2, None, None), (None, "v", ""), (3, "w", long)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", text string, n_chars int")
    out = html_extract.extract(frame).collect()
    assert len(out) == 5 and all(r.n_chars == len(r.text) for r in out)
    assert next(r for r in out if r.page_id == 3).text.count("\n") == 4999
    assert html_extract.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def by_characters(model, module) -> dict[str, float]:
    shares = {}
    for name, html in module.plain().items():
        main = html_extract.unescape("".join(re.findall(r"\[\[(.*?)\]\]", module.LAYOUTS[name], re.S)))
        tree = html_extract.Tree(html)
        chance = model.marginals([tree])[0]
        pieces = [(len(x), (x in main) == (c >= 0.5)) for x, c, v in zip(tree.text, chance, tree.parent) if x and x.strip() and tree.tag[v] != "title"]
        shares[name] = sum(n for n, right in pieces if right) / sum(n for n, _ in pieces)
    return shares


def test_development_layouts(model):
    """The layouts that the model was chosen on, not a measure of new ones; no article comes out empty."""
    shares = by_characters(model, unseen_layouts)
    assert len(shares) == 20 and sum(shares.values()) / 20 > 0.9 and min(shares.values()) > 0.7, shares
    assert all(unseen_layouts.A in model.texts([html])[0] for html in unseen_layouts.plain().values())


def test_fresh_layouts(model):
    """Layouts that nothing was chosen on: 0.836 by characters when they were written, three of twelve under 0.7. The bound only
    notices when that gets worse."""
    shares = by_characters(model, fresh_layouts)
    assert len(shares) == 12 and sum(shares.values()) / 12 > 0.8, shares


@pytest.mark.parametrize("html", ["<span>x" * 100_000, "<div>" + "</i>" * 100_000 + "<p>x" * 50_000, "<svg>" + "<g>" * 100_000, "<b>" * 100_000 + "<h1>a" * 30_000, "<table>" + "<tr><td>" * 50_000 + "x"])
def test_hostile_pages_take_seconds(model, html):
    began = time.time()
    model.texts([html])
    assert time.time() - began < 20
