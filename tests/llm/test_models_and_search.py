"""Classifiers, exact search and page extraction: held-out accuracy, brute force, odd rows."""

from __future__ import annotations

import itertools
import time

import numpy as np
import pytest

from sluice.llm import quality, topk, toxicity, wrapper


def auc(score: np.ndarray, y: np.ndarray) -> float:
    a, b = score[y == 1], score[y == 0]
    return float(((a[:, None] > b[None, :]) + 0.5 * (a[:, None] == b[None, :])).mean())


@pytest.mark.parametrize(("operator", "label"), [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_held_out_accuracy(spark, operator, label):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = operator(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert auc(held["score"].to_numpy(), held[label].to_numpy()) > 0.85


@pytest.mark.parametrize("operator", [quality.quality_scores, toxicity.toxicity_scores])
def test_odd_rows(spark, operator, odd_documents, no_documents):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(10)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = operator(odd_documents, labels).toPandas()
    assert len(got) == odd_documents.count() and got["score"].between(0, 1).all()
    assert operator(odd_documents, labels.limit(0)).count() == odd_documents.count()
    assert operator(no_documents, labels).count() == 0


def brute_kernel(a: str, b: str) -> float:
    """Common subsequences of three letters, by trying all of both words."""

    def found(word: str) -> dict[tuple, float]:
        kinds = [toxicity.START, *[int(toxicity.KINDS[ord(c)]) for c in word], toxicity.END]
        sums, square = {}, 0.0
        for i, j, k in itertools.combinations(range(len(kinds)), 3):
            if k - i < toxicity.SPAN:
                weight = toxicity.DECAY ** (k - i + 1)
                square += weight * weight
                key = (kinds[i], kinds[j], kinds[k])
                sums[key] = sums.get(key, 0.0) + weight
        return {key: x / square**0.5 for key, x in sums.items()}

    one, two = found(a), found(b)
    return sum(x * two.get(key, 0.0) for key, x in one.items())


def test_kernel_is_that_of_brute_force():
    rng = np.random.default_rng(2)
    words = ["".join("abcdé9"[k] for k in rng.integers(0, 6, rng.integers(1, 16))) for _ in range(25)]
    landmarks = toxicity.Expansion(words[:10])
    got = landmarks.kernel(words)
    assert np.allclose(got, [[brute_kernel(a, b) for b in words[:10]] for a in words], atol=1e-4)
    factors = rng.normal(size=10)
    assert np.allclose(toxicity.margins(words, landmarks.combined(factors), 0.5), got @ factors + 0.5, atol=1e-3)


def test_disguised_insults_stay_above_the_margin(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fitted(docs, labels)
    plain = [w for w in ("trash", "idiot", "pathetic", "worthless", "scum", "loser", "stupid", "disgusting", "moron", "clown") if toxicity.margins([w], model.weights, model.bias)[0] > 0]
    assert len(plain) >= 8
    share = lambda words: float((toxicity.margins(words, model.weights, model.bias) > 0).mean())
    assert share(["x".join(w) for w in plain]) >= 0.7
    assert share(["".join(c * 2 for c in w) for w in plain]) >= 0.9
    assert share(["".join(c + ("q" if k % 2 else "") for k, c in enumerate(w)) for w in plain]) >= 0.9
    ordinary = sorted({w for r in docs.join(labels.where("toxic = 0"), "doc_id").select("text").limit(150).collect() for w in toxicity.words_of(r["text"] or "")})
    assert share(ordinary) < 0.02
    spelled = [f"you are such a {x} and that is all" for x in ("i.d.i.o.t", "i d i o t", "I*D*I*O*T")]
    assert (toxicity.evidence([toxicity.words_of(x) for x in spelled], model, {})[:, 0] > 0).all()


def brute_top(rows: list, k: int) -> set:
    out = set()
    usable = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in usable), default=0)
    usable = [(i, [int(x) for x in v] + [0] * (width - len(v))) for i, v in usable]
    for a, (i, v) in enumerate(usable):
        if i % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(usable) if b != a)[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(found)}
    return out


@pytest.mark.parametrize("block", [7, 64])
def test_top_products(spark, block):
    rng = np.random.default_rng(block)
    rows = [(k, (rng.normal(size=8) * rng.choice([0.01, 1, 1, 30])).astype(np.float32).tolist()) for k in range(260)]
    rows[5] = (5, rows[50][1])
    rows += [(1000, None), (1001, []), (1002, [1.0, None]), (1003, [float("nan")] * 8), (1004, [float("inf")] * 8), (None, [1.0] * 8), (1005, [0.5, 0.25]), (1006, [0.0] * 8), (100, rows[7][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS norm", "2 AS v", "3 AS rank")
    got = topk.top_products(vectors, lambda x: x % 50 == 0, k=5, block=block, query_block=3)
    assert {tuple(r) for r in got.collect()} == brute_top(rows, 5)
    assert topk.top_products(vectors.limit(0), lambda x: x % 50 == 0).count() == 0
    few = topk.top_products(vectors.where("vec_id in (50, 51)"), lambda x: x % 50 == 0)
    assert [r["rank"] for r in few.collect()] == [1]


def test_large_products_are_exact():
    q, c = np.array([[2.0**40, 3.0]]), np.array([[2.0**21, 5.0], [1.0, 1.0]])
    assert topk.products(q, c, 1e30).tolist() == [[2**61 + 15, 2**40 + 3]]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<div id="top" class="site-header">Our site</div><nav><ul><li><a href="/a">Home {k}</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="{body}"><h1>Title {k} &amp; more</h1><p>First <b>bold</b>ly  said {k}.<p>Second&nbsp;one<br>goes on {k} &lt;b&gt;
<form><input name=q><button>Go</button></form><div class="comments"><p>first! {k}</p></div></div>
<div class="static">Read more on our pages</div><footer>&copy; {k}</footer></body></html>"""


@pytest.mark.parametrize("body", ["post-body", "x17", "article"])
def test_pages_of_one_host(body):
    pages = [PAGE.format(k=f"{k} " + f"text{k} " * 30, body=body) for k in range(5)]
    if body == "article":
        pages = [p.replace('<div class="article">', "<article>").replace("</div></div>", "</div></article>") for p in pages]
    for k, text in enumerate(wrapper.extracted(pages)):
        own = " ".join(f"{k} {f'text{k} ' * 30}".split())
        assert text == f"Title {own} & more First boldly said {own} . Second one goes on {own} <b>"


def test_broken_pages():
    cut = [wrapper.extracted([p])[0] for p in ("", "plain &lt; text", "<article><p>cut <b>off in the mid", "<article>a</article><!-- never", '<p>a<p class="x', "<script>if (a<b) {}", "<div>" * 500 + "deep")]
    assert cut == ["", "plain < text", "cut off in the mid", "a", "a", "", "deep"]


def test_copies_are_no_template():
    page = "<article><h1>Same title</h1><p>{}</p></article>"
    words = " ".join(f"w{k}" for k in range(80))
    assert all(t.startswith("Same title") for t in wrapper.extracted([page.format(words)] * 6))
    assert all(t.startswith("Same title") for t in wrapper.extracted([page.format(f"{words} {k}") for k in range(6)]))


def test_page_rows(spark, small):
    rows = [(1, "http://a.b/x", PAGE.format(k=1, body="post")), (1, "http://a.b/x", PAGE.format(k=1, body="post")), (2, None, None), (None, "::", ""), (3, "https://A.B:80/y", "<p>one</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS host", "1 AS h", "'t' AS text")
    got = wrapper.main_text(pages, group=2).collect()
    assert len(got) == len(rows) and {r["text"] for r in got if r["page_id"] == 2} == {""}
    assert len({r["text"] for r in got if r["page_id"] == 1}) == 1
    assert wrapper.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "around",
    ["<body class='single has-sidebar'>{}</body>", "<html class='header-fixed'><body>{}</body></html>", "<div id='page' class='with-sidebar'>{}</div>", "<div class='content hide-comments'>{}</div>", "<main class='page no-header'>{}</main>", "<form action='x'><input name='v'>{}</form>"],
)
@pytest.mark.parametrize("n", [1, 5])
def test_names_around_the_article_do_not_hide_it(around, n):
    page = "<h1>Title {k}</h1><p>{words}</p><div class='sidebar'>aside {k}</div>"
    pages = [around.format(page.format(k=k, words=f"some words of page {k} " * 20)) for k in range(n)]
    for k, text in enumerate(wrapper.extracted(pages)):
        assert text == " ".join([f"Title {k}", *[f"some words of page {k}"] * 20])


def test_shared_markup_does_not_turn_template_off(spark):
    shared = "".join(f"<div data-k{k}='v{k}'></div>" for k in range(400))
    page = "<body>{shared}<div class='post'><h2>Always the same notice</h2><p>{own}</p></div></body>"
    pages = [page.format(shared=shared, own=" ".join(f"p{k}w{j}" for j in range(12))) for k in range(12)]
    assert all("notice" not in t and "w11" in t for t in wrapper.extracted(pages))


def test_no_page_of_a_large_host_is_left_alone(spark):
    page = "<div class='post'><h2>Always the same notice</h2><p>{own}</p></div>"
    rows = [(k, f"http://a.b/{k}", page.format(own=" ".join(f"p{k}w{j}" for j in range(20)))) for k in range(129)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = wrapper.main_text(pages).collect()
    assert len(got) == 129 and not [r["page_id"] for r in got if "notice" in r["text"]]


def brute_matching(left: tuple, right: tuple) -> int:
    """The most nodes of two trees with equal roots that match in order, by trying all."""

    def best(a: list, b: list) -> int:
        if not a or not b:
            return 0
        own = brute_matching(a[0], b[0]) + best(a[1:], b[1:]) if a[0][0] == b[0][0] else 0
        return max(own, best(a[1:], b), best(a, b[1:]))

    return 1 + best(left[-1], right[-1])


def test_tree_matching_is_that_of_brute_force():
    rng = np.random.default_rng(4)

    def tree(depth: int) -> tuple:
        return ("abc"[rng.integers(0, 3)], [tree(depth - 1) for _ in range(rng.integers(0, 4))] if depth else [])

    for _ in range(60):
        one, two = ("r", [tree(2) for _ in range(3)]), ("r", [tree(2) for _ in range(3)])
        assert wrapper.matching(one, two) == brute_matching(one, two)


def test_deep_pages_end():
    began = time.time()
    pages = ["".join(f"<div class='l{k}{(n + k) % 2}'><i>{n}</i>" for k in range(200)) + f"words of page {n}" for n in range(3)]
    assert all("words of page" in t for t in wrapper.extracted(pages)) and time.time() - began < 5


def test_alignment_decides_where_names_do_not_tell():
    page = "<body><div class='qa'><b>Our shop</b> since 1990</div><div class='qb'><h2>Always here</h2><p>{own}</p><div class='qd'>Read our terms before you buy</div></div><div class='qc'>Call us today</div></body>"
    pages = [page.format(own=" ".join(f"p{k}w{j}" for j in range(40))) for k in range(6)]
    assert wrapper.extracted(pages) == [" ".join(f"p{k}w{j}" for j in range(40)) for k in range(6)]
    alone = wrapper.extracted(pages[:1])[0]
    assert "Read our terms" in alone and "Always here" in alone
