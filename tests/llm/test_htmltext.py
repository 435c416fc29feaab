"""Main text: the parser, gradients against differences, accuracy on pages and on held-out rewritten pages."""

import time

import numpy as np
import pytest
from blendscope.llm import htmltext as h


def test_blocks_of_untidy_markup():
    page = ("<!DOCTYPE html><title>t</title><script>var a='<p>';</script><style>p{}</style><!-- <p>no --><p>one &amp; <b>two\n three<p>four<br>five"
            "<ul><li>a<li>b</ul><div class='Ad box'>x < y</div>\xa0 <p></p>tail &eacute;<a href=z>link</a>")
    blocks = h.parse(page)
    assert [b[0] for b in blocks] == ["one & two three", "four five", "a", "b", "x < y", "tail élink"]
    assert h.path_code(".ad") in blocks[4][1] and h.path_code(".box") in blocks[4][1]
    assert blocks[5][2] == pytest.approx(4 / 10)
    assert h.parse("") == [] and h.parse("<p") == [] and h.parse("<script>x") == []


def test_gradients_equal_differences():
    pages = [[("a b. c", (1, 2), 0.0), ("d", (3,), 0.5)], [("e f", (1,), 0.0)], [("g", (), 1.0), ("h i", (2, 2), 0.0), ("j", (4,), 0.1)]]
    labels = np.array([1.0, 0, 1, 0, 1, 1])
    model, inputs = h.Labeller(), h.Inputs(pages)

    def loss():
        p = model.forward(model.vectors(inputs), inputs.lengths)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    grads = model.gradients(inputs, labels)
    rng = np.random.default_rng(1)
    for name, value in model.p.items():
        hot = np.flatnonzero(grads[name])
        for at in rng.choice(hot, min(4, len(hot)), replace=False):
            old = value.flat[at]
            value.flat[at] = old + 1e-5
            up = loss()
            value.flat[at] = old - 1e-5
            down = loss()
            value.flat[at] = old
            assert grads[name].flat[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-8)


@pytest.fixture(scope="module")
def pages():
    rng = np.random.default_rng(3)
    words = ["river", "stone", "walk", "under", "bright", "paper", "morning"]
    def text(n):
        return " ".join(words[i] for i in rng.integers(0, 7, n)) + "."
    out = []
    for i in range(120):
        body = [text(int(rng.integers(5, 60))) for _ in range(int(rng.integers(1, 8)))]
        out.append(("<html><body><nav><ul>" + "".join(f"<li><a href=#>{text(1)}</a>" for _ in range(5)) + "</ul></nav><div class=ad>" + text(6)
                    + "</div><article><h1>" + body[0][:20] + "</h1>" + "".join(f"<p>{b}</p>" for b in body) + "</article><footer>" + text(8)
                    + "</footer></body></html>", "\n".join([body[0][:20].strip(), *body])))
    return out


@pytest.fixture(scope="module")
def model(pages):
    return h.train([p for p, _ in pages[:80]])


def test_extracts_whole_articles(frame, pages, model):
    rows = [(i, None, p) for i, (p, _) in enumerate(pages)] + [(None, "u", None), (500, "u", ""), (501, "u", "<p>")]
    got = {r.page_id: r.text for r in h.extract(frame([(*r, "n") for r in rows], "page_id bigint, url string, html string, text string"), model).collect()}
    assert sum(got[i] == want for i, (_, want) in enumerate(pages)) >= 119
    assert got[None] == got[500] == got[501] == ""


def test_rewritten_pages(pages, model):
    rng = np.random.default_rng(11)
    taught = [h.teacher(p) for p, _ in pages[80:]]
    pool = [t for inside, rest in taught for t in [*inside, *rest]]
    right = total = 0
    for inside, _ in taught:
        blocks = h.parse(h.variant(inside, pool, rng))
        want = np.array([b[0].startswith(h.MARK) for b in blocks])
        got = model.label([[(b[0].removeprefix(h.MARK) or " ", *b[1:]) for b in blocks]])[0]
        right += (got == want).sum()
        total += len(want)
    assert right / total > 0.97


def test_batches_do_not_change_labels(pages, model):
    blocks = [h.parse(p) for p, _ in pages[:40]]
    together = model.label(blocks)
    assert all((a == model.label([b])[0]).all() for a, b in zip(together, blocks))


LONG = "The long morning walk went under the old stone bridge, along the river and up to the paper mill."


def div_only(n):
    menu = "".join(f"<li><a href=#{i}>Menu {i}</a>" for i in range(6))
    bodies = [[f"{LONG} Part {i} and {j}." for j in range(2 + i % 3)] for i in range(n)]
    return [(i, "u", f"<html><body><div class=menu><ul>{menu}</ul></div><div class=content>" + "".join(f"<p>{b}</p>" for b in body)
             + "</div><div class=footer>All rights reserved, page " + str(i) + "</div></body></html>", "\n".join(body)) for i, body in enumerate(bodies)]


@pytest.mark.parametrize("n", [5, 60])
def test_pages_without_article_tags(frame, n):
    pages = div_only(n)
    table = frame([p[:3] for p in pages], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in h.extract(table, h.fit(table)).collect()}
    assert sum(got[p[0]] == p[3] for p in pages) >= 0.9 * n


def test_without_pages(frame):
    empty = frame([], "page_id bigint, url string, html string")
    model = h.fit(empty)
    assert h.extract(empty, model).count() == 0
    body = "".join(f"<p>{LONG}</p>" for _ in range(4))
    page = f"<html><body><nav><ul><li><a href=#>a</a><li><a href=#>b</a></ul></nav><article>{body}</article><footer>imprint</footer></body></html>"
    assert h.extract(frame([(1, "u", page)], "page_id bigint, url string, html string"), model).first().text == "\n".join([LONG] * 4)


def test_untidy_markup_loses_no_text():
    def texts(page):
        return [b[0] for b in h.parse(page)]

    assert texts("<p title=it's>Hello world</p><p>we don't stop</p>") == ["Hello world", "we don't stop"]
    assert texts("<p>a</p><select><option>x<p>rest</p><p>more") == ["a", "x", "rest", "more"]
    assert texts("<p>a</p><select><option>x</select><svg><text>no</text></svg><object>gone</object><p>b") == ["a", "b"]
    assert texts('<p title="a > b" class=c>x</p><p title = \'>\'>y<p title="open>z') == ["x", "y", "z"]
    assert texts("a<script>b<p>c") == ["a"] and texts("<div =>a</div><a b=\"c\"d='e'f>g") == ["a", "g"]
    assert texts("</div></b><p>a</i></span>b</p></p>c") == ["ab", "c"]


@pytest.mark.parametrize("page", ["<div>a" * 100_000, "<b>" * 100_000 + "x" + "</i>" * 100_000, "<div>" * 100_000 + "</p>" * 100_000 + "x",
                                  "<select>" * 50_000 + "x", "<p a=\"b" * 50_000, "<p>x</p>" * 100_000])
def test_long_and_deep_pages_take_linear_time(page):
    started = time.perf_counter()
    blocks = h.parse(page)
    assert time.perf_counter() - started < 20 and max((len(b[1]) for b in blocks), default=0) <= h.PATH_DEPTH


def test_a_long_page_does_not_widen_the_grid_of_others(model):
    pages = [h.parse("<p>word here</p>" * n) for n in (30_000, 1, 2, 0, 5)]
    sizes = []
    plain = model.grid
    model.grid = lambda lengths: sizes.append(len(lengths) * lengths.max(initial=0)) or plain(lengths)
    labels = model.label(pages)
    del model.grid
    assert [len(x) for x in labels] == [30_000, 1, 2, 0, 5] and sizes == [15, 30_000]


def test_repeated_page_ids_choose_the_same_sample(frame):
    rows = [(i % 7, "u", f"<article><p>{LONG} {i}</p></article>") for i in range(70)]
    one, two = (h.fit(frame(r, "page_id bigint, url string, html string")) for r in (rows, rows[::-1]))
    assert all((one.p[k] == two.p[k]).all() for k in one.p)
