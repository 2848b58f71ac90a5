import random
import time
import zlib

import numpy as np
import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from tideglass.llm import html_text, quality
from tideglass.llm.html_text import extract_text, main_text


def test_page():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>x</a></ul></nav><!-- <p>no -->"
        "<div class=\"ad\">Buy, now.</div><article><h1>A &amp; B</h1><p><b>One,  two\n three.<br><p>Of.</p><div class='share-bar'>s</div><section id=comments><p>Nice, really.</p></section>"
        "<ul><li>item one<li>item two</ul></article><aside>side</aside><form><p>mail</p></form><footer>&copy; f</footer>"
    )
    assert main_text(page) == "A & B\nOne, two three.\nOf.\nitem one\nitem two"


def test_without_article():
    long = "Some words, and more words. " * 8
    page = f"<body><div class=menu><a>a</a></div><div><div id=c><h2>Head</h2><p>{long}</p><p>{long}<i>x</i></p><p>End.</p></div></div><div id='cookie-notice'>Cookies, cookies.</div></body>"
    assert main_text(page) == "\n".join(["Head", long.strip(), long + "x", "End."]).replace("  ", " ")


def test_siblings_without_article():
    long = "Some words, and more words."
    for n, m in ((6, 4), (5, 5), (4, 6)):
        page = f"<body><div class=menu><a>a</a></div><div><section><h2>One</h2>{f'<p>{long}</p>' * n}</section><section><h2>Two</h2>{f'<p>{long}</p>' * m}</section></div></body>"
        assert main_text(page) == "\n".join(["One", *[long] * n, "Two", *[long] * m])
        page = f"<body><div id=lead>{f'<p>{long}</p>' * n}</div><div id=text>{f'<p>{long}</p>' * m}</div></body>"
        assert main_text(page) == "\n".join([long] * (n + m))


def test_wrappers_are_no_regions():
    long = "Some words, and more words."
    body, rest = f"<h2>Head</h2>{f'<p>{long}</p>' * 5}", "<div class=sidebar><p>Side, side.</p></div><div class='share-bar'>s</div>"
    want = "\n".join(["Head", *[long] * 5])
    opens = [f"<div class='{c}'>" for c in ("page has-sidebar", "no-sidebar", "comments-open", "menu-closed", "page sidebar", "site-banner x")]
    for tag in [*opens, "<form id=aspnet>", "<form><div class='menu'>"]:
        for text in (f"<article>{body}</article>", f"<main>{body}</main>", f"<div id=c>{body}</div>"):
            assert main_text(f"<body><nav>n</nav>{tag}{text}{rest}</body>") == want, (tag, text)


def test_marked_regions_stay_out():
    long = "Some words, and more words."
    text, more = f"<p>{long}</p>" * 3, f"<p>{long}</p>" * 6
    for page in (f"<article>{text}</article><div class=comments>{more}</div>", f"<div id=c>{text}</div><div class=comments>{more}</div>", f"<div id=c>{text}</div><form>{more}</form>"):
        assert main_text(f"<body>{page}</body>") == "\n".join([long] * 3)


def test_scores_select_the_blocks(monkeypatch):
    """Without an article or any telling name, only the scores keep lists of links out."""
    long = "Some words, and more words, that go on for a while. They end here."
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(8))
    body = f"<h2>Head</h2>{f'<p>{long}</p>' * 6}<ul><li>one</li><li>two</li></ul>"
    page = f"<body><div class=u><ul>{links}</ul></div><div class=v><div><p><a>Log in</a> now</p></div></div><div class=w>{body}</div><div class=x><p><a>Next</a></p></div></body>"
    want = "\n".join(["Head", *[long] * 6, "one", "two"])
    assert main_text(page) == want
    monkeypatch.setattr(html_text, "path_scores", lambda found, tags: [1.0] * len(found))
    assert main_text(page) != want and "Log in" in main_text(page)


def test_pages_without_article_as_with_one(spark):
    """The sample pages with their articles turned into plain divisions give the same texts by ratios alone."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()
    for r in rows:
        bare = r.html.replace("<article>", "<div class=z>").replace("</article>", "</div>")
        assert main_text(bare) == main_text(r.html)


def plain_scores(found, tags):
    """The scores of ``path_scores``, path by path and without arrays."""
    forgiven = html_text.wrappers(found, tags)
    keys = [(b.path, b.out or any(n not in forgiven for n in b.named)) for b in found]
    order = sorted(set(keys), key=keys.index)
    own_blocks = {k: [b for b, x in zip(found, keys, strict=True) if x == k] for k in order}
    free = {k: sum(len(b.text) - 0.9 * b.linked for b in v) for k, v in own_blocks.items()}
    points = {k: sum(c in ".,;:!?…、。，！？" for b in v for c in b.text) for k, v in own_blocks.items()}
    first = lambda k: next((i for i, e in enumerate(k[0]) if e.split(".")[0] in ("article", "main")), None)
    article = {k: k[0][: first(k) + 1] if first(k) is not None else None for k in order}
    held = {}
    for k in order:
        held[article[k]] = held.get(article[k], 0) + (0 if k[1] else free[k])
    main = max((a for a in held if a), key=lambda a: held[a], default=None)
    main = main if main and 2 * held[main] >= sum(held.values()) else None
    evidence, own = {}, {}
    for i, k in enumerate(order):
        near = [order[max(i - 1, 0)], k, order[min(i + 1, len(order) - 1)]]
        text, marks = (sum(w * total[x] / len(own_blocks[x]) for w, x in zip(html_text.KERNEL, near, strict=True)) for total in (free, points))
        evidence[k] = html_text.MARKED if k[1] else 1
        if main and article[k] != main:
            evidence[k] *= html_text.BESIDE
        elif not article[k] and sum(b.linked for b in own_blocks[k]) * 2 > sum(len(b.text) for b in own_blocks[k]):
            evidence[k] *= html_text.LINKED
        own[k] = (text * (marks + 0.1)) ** 0.5 * evidence[k]
    around = lambda k: [k[0][:i] for i in range(len(k[0]), 0, -1) if k[0][i - 1].split(".")[0] in html_text.CONTAINERS - {"html", "body"}] + [()]
    top = max((own[k] for k in order if not k[1]), default=0)
    out = {}
    for k in order:
        share, score = 1.0, own[k]
        for c in around(k):
            score = max(score, evidence[k] * share * max(own[x] for x in order if c == () or c in around(x)))
            if main is None or article[k] != main or c == main:
                share *= html_text.FURTHER
        out[k] = score / top if top else 0.0
    return [out[k] for k in keys]


def test_scores_as_brute_force():
    rng = random.Random(9)
    said = ["Some words, and more. ", "menu", "x", "A long line of words without any point at all ", "One. Two. Three! "]

    def made_of(depth):
        if depth == 0 or rng.random() < 0.3:
            text = rng.choice(said) * rng.choice([1, 2, 9])
            return f"<p>{f'<a>{text}</a>' if rng.random() < 0.3 else text}</p>"
        tag = rng.choice(["div", "div class=c1", "div class='menu'", "section", "article", "main", "ul", "nav", "form", "div id=sidebar", "td"])
        return f"<{tag}>{''.join(made_of(depth - 1) for _ in range(rng.randrange(1, 4)))}</{tag.split()[0]}>"

    seen = set()
    for _ in range(300):
        found, tags = html_text.blocks(f"<body>{''.join(made_of(3) for _ in range(3))}</body>")
        got = html_text.path_scores(found, tags)
        assert np.allclose(got, plain_scores(found, tags), atol=1e-12)
        seen.update(x >= html_text.THRESHOLD for x in got)
    assert seen == {True, False}


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, "<a " * 350_000 + ">", "<!-- " * 200_000, "<div>x" * 50_000, "<div class=menu>x." * 50_000, "<article><div>x, y." * 30_000, "<div>x" * 30_000 + "</section>" * 60_000, "<a '\">" * 150_000, "<p>a" * 100_000, "<div class=a>" * 50_000 + "<li>x<figure>" * 20_000, "<script" * 100_000, "&amp" * 250_000],
    ids=range(12),
)
def test_long_broken_and_deep_pages_take_linear_time(page):
    began = time.time()
    main_text(page)
    assert time.time() - began < 20


def test_broken_and_empty(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>a<p>b</div></body>"), (4, "u", "<script>never closed <p>x"), (5, "u", "a < b & c &am"), (6, "u", "<div" * 3000), (6, "u", "<p>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = [(r.page_id, r.text, r.n_chars) for r in extract_text(df).collect()]
    assert got[:5] == [(1, "", 0), (2, "", 0), (None, "a\nb", 3), (4, "", 0), (5, "a < b & c &am", 13)] and got[6] == (6, "deep", 4)
    assert extract_text(df.limit(0)).collect() == []


def made(n):
    rng = random.Random(1)
    words = ["the", "and", "river", "stone", "under", "cloud", "Light", "walks"]
    out = []
    for i in range(n):
        good = rng.random() < 0.7
        w = [rng.choice(words) for _ in range(rng.choice([20, 80, 200]))]
        if not good:
            w = rng.choice([[x.upper() + "!!" for x in w], [x for x in w[::5] for _ in range(5)], [x + "$$$" for x in w]])
        out.append((i, " ".join(w), int(good)))
    return out


def test_held_out_accuracy(spark):
    rows = made(800)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(9001, None), (9002, ""), (None, "x"), (3, rows[3][1])], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5, None), (7, 9)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).toPandas()
    truth = {i: q for i, _, q in rows}
    apart = got[got.held_out & got.doc_id.isin(list(truth))]
    assert (apart.predicted == apart.doc_id.map(truth)).mean() > 0.97
    assert len(got) == 804 and got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    for i, h in zip(got.doc_id, got.held_out):
        if i == i:
            assert h == (zlib.crc32(str(int(i)).encode()) % 4 == 2)
    kept = quality.good_documents(docs, labels).toPandas()
    assert sorted(kept.doc_id.fillna(-1)) == sorted(got[got.predicted == 1].doc_id.fillna(-1)) and list(kept.columns) == docs.columns
    assert set(quality.quality_scores(docs, labels.limit(0)).toPandas().score) == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).collect() == []


def test_held_out_labels_are_never_used(spark):
    rows = made(300)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = [(i, q) for i, _, q in rows]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in labels]
    a, b = (quality.quality_scores(docs, spark.createDataFrame(x, "doc_id long, quality int")).orderBy("doc_id").toPandas() for x in (labels, turned))
    assert (a.score == b.score).all()


def test_hinge_loss_is_at_its_minimum():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 3))
    sign = np.where(x[:, 0] + 0.3 * rng.standard_normal(60) > 0, 1.0, -1.0)
    cost = np.ones(60)
    w, b = quality.dual_descent(np.tile(np.arange(3), 60), x.ravel(), np.arange(60)[:, None] * 3 + [0, 3], sign, cost, 3)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + np.maximum(0, 1 - sign * (x @ w + b)).sum()

    assert all(loss(w, b) <= loss(w + d[:3], b + d[3]) + 0.05 for d in 0.2 * rng.standard_normal((200, 4)))


def test_scores_as_a_plain_model(spark):
    """The whole model again, text by text with dictionaries, and its hinge loss at the fitted weights near the least that plain descent finds."""
    rows = made(240)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = quality.fit_model(docs, labels)
    batch = pa.RecordBatch.from_pydict({"text": [x for _, x, _ in rows]})
    sets = [set(x.tolist()) for x in quality.features(batch)]
    known = sorted((i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 4 != 2)
    order = np.random.default_rng(quality.SEED).permutation(len(known)).tolist()
    train = [known[k] for k in order[len(order) // 5 :]]
    counts = [{}, {}]
    for i, q in train:
        for f in sets[i]:
            counts[q][f] = counts[q].get(f, 0) + 1
    total = [sum(c.values()) + quality.FEATURES * quality.SMOOTHING for c in counts]
    scale = {}
    for f in set(counts[0]) | set(counts[1]):
        n = [c.get(f, 0) for c in counts]
        if sum(n) >= quality.MIN_TEXTS:
            scale[f] = np.log((n[1] + quality.SMOOTHING) / total[1]) - np.log((n[0] + quality.SMOOTHING) / total[0])
    assert {f for f in np.flatnonzero(model.scale).tolist()} == {f for f, v in scale.items() if abs(v) > 1e-7}
    assert all(abs(model.scale[f] - v) < 1e-4 for f, v in scale.items())
    unit = []
    for i, _ in train:
        v = {f: scale[f] for f in sets[i] if f in scale}
        norm = sum(x * x for x in v.values()) ** 0.5
        unit.append({f: x / norm for f, x in v.items()})
    sign = [1 if q else -1 for _, q in train]
    cost = [len(sign) / 2 / sign.count(y) for y in sign]

    def loss(w, b):
        return (sum(x * x for x in w.values()) + b * b) / 2 + sum(c * max(0, 1 - y * (sum(x * w.get(f, 0) for f, x in v.items()) + b)) for v, y, c in zip(unit, sign, cost, strict=True))

    w, b, dual = {}, 0.0, [0.0] * len(sign)
    for _ in range(60):
        for k, (v, y, c) in enumerate(zip(unit, sign, cost, strict=True)):
            new = min(max(dual[k] - (y * (sum(x * w.get(f, 0) for f, x in v.items()) + b) - 1) / 2, 0), c)
            step, dual[k] = y * (new - dual[k]), new
            b += step
            for f, x in v.items():
                w[f] = w.get(f, 0) + step * x
    ours = {f: float(model.weights[f]) for f in np.flatnonzero(model.weights).tolist()}
    assert loss(ours, model.bias) <= loss(w, b) * 1.02 + 1e-6
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    for i, _, _ in rows:
        v = {f: scale[f] for f in sets[i] if f in scale}
        norm = sum(x * x for x in v.values()) ** 0.5
        plain = sum(x * ours.get(f, 0) for f, x in v.items()) / norm + model.bias
        assert abs(got[i] - 1 / (1 + np.exp(-(model.slope * plain + model.shift)))) < 1e-3


def test_the_fit_is_bounded(spark):
    rows = made(60)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1, f"x{i} y z") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    kept = []
    fitted = quality.fit
    try:
        quality.fit = lambda index, bounds, labels: kept.append((len(index), len(labels))) or fitted(index, bounds, labels)
        quality.fit_model(docs, labels)
        quality.fit_model(docs, labels, rows=20, size=3000)
    finally:
        quality.fit = fitted
    assert kept[0][1] == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _, _ in rows) and kept[1][0] <= 750 and 0 < kept[1][1] < 20
