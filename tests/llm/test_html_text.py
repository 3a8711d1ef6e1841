import time

import numpy as np
import pytest

from lorekeep.llm import html_text as X


@pytest.fixture(scope="module")
def model():
    return X.train(pages=500, epochs=4)


def test_blocks():
    b = X.blocks("<body><p class=a>One&amp;two<b> x</b>\n<br>y<p>Three &#233;<script>if (a < b) '</p>'</script><div>in<a href='>'>link</a></div>tail&am")
    assert [(x[1], x[2]) for x in b] == [("One&two x y", 0), ("Three é", 0), ("inlink", 4), ("tail&am", 0)]
    assert [x[1] for x in X.blocks("<ul><li>a<ul><li>b</ul><li>c</ul><table><tr><td>1<td>2<tr><td>3</table><!-- <p>no -->z")] == ["a", "b", "c", "1", "2", "3", "z"]
    assert X.blocks(None) == X.blocks("") == X.blocks("<script>x") == X.blocks("<!-- a") == []
    assert [x[1] for x in X.blocks("<p title=\"x>y'>t</p>")] != []


def test_deep_and_unclosed_elements_take_linear_time():
    """Sums along paths are those of all features above a block; 40,000 levels are no more work than 40,000 siblings."""
    html = "<div class='a b'>x<p id=c>y<section><li>z<ul><li>1<li>2</ul>"
    p, table = X.blocks(html), np.random.default_rng(5).standard_normal((X.PATHS, 3))
    f = X.path_features
    want = [f("div", " class='a b'"), f("div", " class='a b'") + f("p", " id=c"), f("div", " class='a b'") + f("section", "") + f("li", ""), *[f("div", " class='a b'") + f("section", "") + f("li", "") + f("ul", "") + f("li", "")] * 2]
    got = X.Paths([p, X.blocks("top"), p]).means(table)
    assert np.allclose(got, np.array([*(table[list(w)].mean(0) for w in want), np.zeros(3), *(table[list(w)].mean(0) for w in want)]), atol=1e-5)
    for page in ("<div>" * 40_000 + "x" + "</div>" * 40_000, "<b>x<p>" * 20_000, "<li>" + "<span>" * 20_000 + "<li>x" * 20_000):
        began = time.process_time()
        assert X.blocks(page) and time.process_time() - began < 4 and X.Paths([X.blocks(page)]).means(table).shape[1] == 3


HAND = [
    ("<body><div id=top><a href=/>Gazette</a></div><div class=menu><a href=/a>Sports</a> <a href=/b>Weather</a></div><div id=content><h1>Bridge reopens</h1><p>The old bridge over the river was opened again on Monday, after two years of repairs.</p><p>Buses will use it from next week on.</p></div><div class=sidebar><h3>Popular</h3><p><a href=/c>Ten cakes to bake</a></p></div><div id=footer>&copy; Gazette. All rights reserved.</div>",
     "Bridge reopens\n\nThe old bridge over the river was opened again on Monday, after two years of repairs.\n\nBuses will use it from next week on."),
    ("<html><body><header><nav><ul><li><a href=/>Start</a><li><a href=/blog>Blog</a></ul></nav></header><main><article><h2>Growing beans</h2><p>Beans need warm soil &amp; little else. Sow them in May, two fingers deep.</p><ul><li>Water them twice a week.<li>Tie them to a pole.</ul></article><section class=comments><h3>Comments</h3><div class=comment>Great tips, thanks!</div></section></main><footer><p>Contact us</p></footer>",
     "Growing beans\n\nBeans need warm soil & little else. Sow them in May, two fingers deep.\n\nWater them twice a week.\n\nTie them to a pole."),
    ("<body><div class='cookie-notice'>We use cookies. <button>OK</button></div><div class=post><h1>On knots</h1><p>A good knot holds under load and comes loose when it should.</p><div class=advert>Buy our ropes now!</div><p>The bowline is such a knot, and sailors have trusted it for ages.</p></div><form class=newsletter><p>Subscribe to our letter</p><input></form>",
     "On knots\n\nA good knot holds under load and comes loose when it should.\n\nThe bowline is such a knot, and sailors have trusted it for ages."),
]


def test_pages_written_by_hand():
    model, parsed = X.standard(), [X.blocks(h) for h, _ in HAND]
    for p, (_, want), y in zip(parsed, HAND, model.label(parsed)):
        assert "\n\n".join(b[1] for b, own in zip(p, y) if own) == want


def test_learnt_on_made_up_pages(model):
    rng, right, total = np.random.default_rng(99), 0, 0
    for _ in range(150):
        html, y = X.made_up(rng)
        b = X.blocks(html)
        assert len(b) == len(y)
        right, total = right + (model.label([b])[0] == np.array(y, bool)).sum(), total + len(y)
    assert right > 0.97 * total


def test_same_labels_alone_and_together(model):
    rng = np.random.default_rng(3)
    pages = [X.blocks(X.made_up(rng)[0]) for _ in range(12)] + [X.blocks("")]
    assert all((a == model.label([p])[0]).all() for a, p in zip(model.label(pages), pages))


def test_pages(spark, model):
    article = "<article><h1>Title of it</h1><p>First, a long sentence of the article that goes on.<p>Second &lt;one&gt;.</article>"
    page = f"<html><head><title>T</title></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li></ul></nav><div class='ad'>Buy now.</div>{article}<footer>&copy; 2020 Somebody</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", page), (1, "u", page), (4, "x", "<p>" + "long text, " * 50_000)]
    df = spark.createDataFrame([(*r, "t", 0) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = X.extract(df, model).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    by = {(r.page_id, r.url): r.text for r in got}
    want = "Title of it\n\nFirst, a long sentence of the article that goes on.\n\nSecond <one>."
    assert by[1, "u"] == by[None, "w"] == want and by[2, None] == by[3, "v"] == "" and len(by[4, "x"]) == 549_999
    assert X.extract(df.limit(0), model).count() == 0


def test_gradient(model):
    rng = np.random.default_rng(4)
    m = X.Labeller(rng)
    data = [(b, y) for b, y in ((X.blocks(h), y) for h, y in (X.made_up(rng) for _ in range(6)))]
    y = np.array([v for _, ys in data for v in ys], np.float32)
    losses, past = [], {}
    for _ in range(40):
        losses.append(m.step([b for b, _ in data], y, past))
    assert losses[-1] < 0.2 * losses[0]
