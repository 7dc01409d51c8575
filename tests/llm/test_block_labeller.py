import math
import random
import tracemalloc

import numpy as np
import pytest

from namesmith.llm import block_labeller as L

from .common import prose

PAGE = "page_id long, url string, html string, text string"


def page(rng, article=("<article>", "</article>"), inner="", after=""):
    words = [prose(rng, rng.randrange(8, 40)) for _ in range(rng.randrange(2, 6))]
    nav = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in prose(rng, 5).split())
    body = inner.join(f"<p>{w}</p>" for w in words)
    html = (f"<!DOCTYPE html><html><head><title>{words[0][:20]}</title><style>p{{}}</style><script>"
            f'var t="</p>";</script></head><body><nav><ul>{nav}</ul></nav><div class="ad">'
            f"{prose(rng, 6)}</div>{article[0]}<h1>Head &amp; line</h1>{body}{article[1]}{after}"
            f"<footer>&copy; {prose(rng, 5)}</footer></body></html>")
    return html, "\n\n".join(["Head & line", *words])


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(0)
    return [page(rng) for _ in range(150)]


def run(spark, rows):
    df = L.extract_text(spark.createDataFrame(rows, PAGE).repartition(2))
    assert df.columns == ["page_id", "url", "text", "n_chars"]
    return {r.page_id: r for r in df.collect()}


def test_articles_of_known_and_other_templates(spark, pages):
    rng = random.Random(1)
    other = [page(rng, ('<div class="content">', "</div>"), after='<div class="comments"><p>'
                  + prose(rng, 12) + "</p></div>") for _ in range(20)]
    other += [page(rng, inner=f'<aside>{prose(rng, 9)}</aside>') for _ in range(20)]
    every = pages + other
    got = run(spark, [(i, f"u{i}", h, "x") for i, (h, _) in enumerate(every)])
    right = [got[i].text == want for i, (_, want) in enumerate(every)]
    assert all(right[:150])
    assert np.mean(right[150:]) >= 0.9
    assert all(r.n_chars == len(r.text) and r.url == f"u{i}" for i, r in got.items())


def test_awkward_pages(spark, pages):
    rows = [(i, "u", h, None) for i, (h, _) in enumerate(pages)]
    long = "word " * 50_000
    rows += [(1000, None, None, None), (1001, "u", "", None), (1002, "u", "<p", None),
             (1003, "u", f"<body><article><p>{long}</p></article>", None), (None, "u", "<b>", None)]
    got = run(spark, rows + [rows[0]])
    assert got[1000].text == got[1001].text == "" and got[1000].n_chars == 0
    assert got[1003].text == long.strip()
    assert L.extract_text(spark.createDataFrame([], PAGE)).collect() == []


def test_leaf_blocks():
    blocks = L.leaf_blocks(
        '<body class=x><p><b>One<br><p>two &lt;b&gt; <i>3</i>\n 4<ul><li>a<li><a href="#">b c</a></ul>'
        '<!-- <p>no</p> --><script>if (a<b) "</p>"</script>tail</div> end<img alt=">"> &nbsp;x')
    assert [b.text for b in blocks] == ["One", "two <b> 3 4", "a", "b c", "tail", "end x"]
    assert blocks[3].linked == 3 and blocks[1].path == ["<body", ".x", "<p"]
    assert L.leaf_blocks(None) == []


def test_gradients_equal_differences():
    rng = np.random.RandomState(1)
    net = {k: v.astype(float) for k, v in L.new_network(5).items()}
    x, y, mask = rng.randn(4, 3, 5), (rng.rand(4, 3) > 0.5) * 1.0, np.ones((4, 3))
    mask[3, 1] = mask[2:, 2] = 0

    def loss():
        p = L.label_scores(net, x, mask)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    grad = L.gradients(net, x, mask, y)
    for k in net:
        at = np.unravel_index(np.abs(grad[k]).argmax(), net[k].shape)
        kept = net[k][at]
        net[k][at] = kept + 1e-3
        up = loss()
        net[k][at] = kept - 1e-3
        assert abs((up - loss()) / 2e-3 - grad[k][at]) < 1e-4
        net[k][at] = kept


def plain_page(rng, article=("<div>", "</div>")):
    words = [prose(rng, rng.randrange(8, 60)) for _ in range(rng.randrange(2, 7))]
    links = " ".join(f'<a href="/{w}">{w}</a>' for w in prose(rng, 6).split())
    html = (f"<html><head><title>{words[0][:20]}</title></head><body><div>{links}</div>{article[0]}"
            f"<h1>Head line</h1>{''.join(f'<p>{w}</p>' for w in words)}{article[1]}<div>&copy; "
            f"{prose(rng, 4)}</div></body></html>")
    return html, ["Head line", *words]


def test_pages_without_article_markup_have_text(spark):
    rng = random.Random(5)
    every = [plain_page(rng) for _ in range(80)]
    got = run(spark, [(i, "u", h, "x") for i, (h, _) in enumerate(every)])
    kept = [set(got[i].text.split("\n\n")) & set(want) for i, (_, want) in enumerate(every)]
    share = sum(map(len, kept)) / sum(len(want) for _, want in every)
    extra = sum(len(set(got[i].text.split("\n\n")) - set(want)) for i, (_, want) in enumerate(every))
    assert share >= 0.9
    assert extra <= 0.1 * sum(len(want) for _, want in every)


def test_sample_is_drawn_from_pages_that_teach(spark):
    rng = random.Random(6)
    # marked for the eye only: in a comment, in boilerplate, in the text
    no = [plain_page(rng, (f"<!-- <article> --><nav class='main'>x{i}</nav><div>", "</div>"))[0]
          for i in range(600)]
    no += [plain_page(rng, ("<div>the content of class=main ", "</div>"))[0] for _ in range(100)]
    yes = [plain_page(rng, a)[0] for a in [
        ("<article>", "</article>"), ("<MAIN\n>", "</MAIN>"), ('<div id = "x main-text">', "</div>"),
        ("<div role=main>", "</div>"), ("<div class\xa0='a Story'>", "</div>")] for _ in range(6)]
    df = spark.createDataFrame([(h,) for h in no + yes + yes[:3]] + [(None,)], "html string")
    assert sorted(L.teachable(df.repartition(3), 300)) == sorted(yes)
    drawn = L.teachable(df.repartition(5), 20)
    assert len(set(drawn)) == 20 and set(drawn) <= set(yes)


@pytest.mark.parametrize("page, want", [
    ('<p>one</p><svg class="i"/><p>two</p>', ["one", "two"]),
    ("<p>one<math/> two</p>three", ["one two", "three"]),
    ("<p>one</p><svg viewBox='0 0 1 1'><path d=m /></svg><p>two</p>", ["one", "two"]),
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>", ["so x=1 holds"]),
    ("<object data=a><p>fallback</p></object><canvas>drawn</canvas> end", ["fallback", "drawn end"]),
    ("<canvas>one<p>two</p>", ["one", "two"]),
    ("<object><p>one</p><div>two</div>", ["one", "two"]),
    ("<template><p>one</p></template><p>two</p>", ["one", "two"]),
    ("<template><p>one</p><p>two</p>", ["one", "two"]),
    ("<p>pick <select><option>a<option>b</select> now</p>", ["pick", "a", "b", "now"]),
    ("<select><optgroup><option>a<p>two</p><p>three</p>", ["a", "two", "three"]),
    ("<p>one</p><script>no<p></script><style>no</style><noscript><p>no</p></noscript>"
     "<iframe>no</iframe><textarea>no</textarea>two", ["one", "two"]),
])
def test_only_raw_elements_lose_their_content(page, want):
    assert [b.text for b in L.leaf_blocks(page)] == want


def test_unclosed_select_holds_nothing_that_follows():
    blocks = L.leaf_blocks("<article><select><option>a<p>two</p>three<select>b</article><p>c")
    assert [b.path for b in blocks] == [
        ["<article", "<select", "<option"], ["<article", "<p"], ["<article"],
        ["<article", "<select"], ["<p"]]
    assert L.taught_labels(blocks) == [0, 1, 1, 0, 0]


def test_a_class_named_title_is_no_boilerplate():
    blocks = L.leaf_blocks('<head><title>t</title></head><article><h1 class="entry-title">One</h1>'
                           "<p>two</p><svg><title>icon</title></svg></article>")
    assert [b.text for b in blocks] == ["t", "One", "two", "icon"]
    assert L.taught_labels(blocks) == [0, 1, 1, 0]


def plain_scores(net, x):
    """One page through both directions, gate by gate and number by number."""
    H = L.HIDDEN
    sig = lambda v: 1 / (1 + math.exp(-v))
    totals = [float(net["bias"][0])] * len(x)
    for side, half in (("f", 0), ("b", H)):
        h, c = [0.0] * H, [0.0] * H
        for t in range(len(x)) if side == "f" else reversed(range(len(x))):
            gates = [sum(float(v) * float(w) for v, w in zip(x[t], net["x" + side][:, k]))
                     + sum(v * float(w) for v, w in zip(h, net["h" + side][:, k]))
                     + float(net["b" + side][k]) for k in range(4 * H)]
            c = [sig(gates[H + j]) * c[j] + sig(gates[j]) * math.tanh(gates[3 * H + j])
                 for j in range(H)]
            h = [sig(gates[2 * H + j]) * math.tanh(c[j]) for j in range(H)]
            totals[t] += sum(v * float(w) for v, w in zip(h, net["out"][half : half + H]))
    return [sig(v) for v in totals]


def test_scores_equal_a_plain_network():
    rng = np.random.RandomState(4)
    net = L.new_network(6)
    pages = [rng.randn(n, 6).astype(np.float32) for n in (1, 5, 9)]
    x, mask = L._padded(pages)
    whole = L.label_scores(net, x, mask)
    parts = L.segment_scores(net, lambda k: (x[2 * k : 2 * k + 2], mask[2 * k : 2 * k + 2]), 5)
    for k, p in enumerate(pages):
        want = plain_scores(net, p)
        assert np.allclose(whole[: len(p), k], want, atol=1e-5)
        assert np.allclose(parts[: len(p), k], want, atol=1e-5)


def test_long_pages_take_bounded_memory(monkeypatch):
    rng = random.Random(9)
    words = prose(rng, 400).split()
    html = "<body><article>" + "".join(
        f"<p>{words[i % 400]} {words[i % 7]} {i}.</p>" for i in range(50_000)) + "</article></body>"
    net, n = L.new_network(L.PATH_SLOTS + L.WORD_SLOTS + L.SIZES), len(L.leaf_blocks(html))
    assert n == 50_000
    net["bias"] += 5  # every block is text
    tracemalloc.start()
    [text] = L.page_texts([html], net, L.Vectors())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert text.count("\n\n") == n - 1 and peak < 150e6
    net["bias"] -= 5
    some = [html[:40_000], "<p>one</p><p>two</p>", None, html[:9_000]]
    want = L.page_texts(some, net, L.Vectors())
    monkeypatch.setattr(L, "_STEPS", 100)
    monkeypatch.setattr(L, "_CHARACTERS", 10_000)
    assert L.page_texts(some, net, L.Vectors()) == want
    assert [len(p) for p in L._portions(some)] == [1, 3]
