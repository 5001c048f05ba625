import itertools
import re

import numpy as np

from riskflow.llm import html_crf
from riskflow.llm.queries import op6_main_text

MODEL = html_crf.model_of()


def test_held_out_accuracy():
    right = total = 0
    for chain, labels in html_crf.training_pages(60, seed=99):
        got = MODEL.viterbi(MODEL.scores(chain))
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right > 0.94 * total  # some of these layouts leave no trace but the words, which are random


def test_viterbi_and_expectations_against_all_labellings():
    rnd = np.random.default_rng(2)
    model = html_crf.Crf({}, np.zeros((0, 2)), rnd.normal(size=(2, 2)))
    scores = rnd.normal(size=(5, 2))
    every = list(itertools.product((0, 1), repeat=5))
    value = [sum(scores[i, y] for i, y in enumerate(ys)) + sum(model.moves[a, b] for a, b in zip(ys, ys[1:])) for ys in every]
    assert model.viterbi(scores) == list(every[int(np.argmax(value))])
    p = np.exp(value) / np.exp(value).sum()
    labels, moves, norm = model.expected(scores)
    assert np.allclose(labels[:, 1], [sum(q for q, ys in zip(p, every) if ys[i]) for i in range(5)])
    assert np.isclose(norm, np.log(np.exp(value).sum())) and np.isclose(moves.sum(), 4)


def test_blocks():
    page = '<p>a &amp; b<br>c\n d<p><b>e</b> &lt;f<!-- no --><script>x("</p>")</script></div>g<ul><li>h<li>i</ul> 1 < 2 <a href="x>y">k</a>'
    assert [b.text for b in html_crf.leaf_blocks(page)] == ["a & b c d", "e <f", "g", "h", "i", "1 < 2 k"]
    assert html_crf.leaf_blocks(None) == html_crf.leaf_blocks("") == html_crf.leaf_blocks("<p> </p>") == []


def test_unseen_layout():
    page = """<html><head><title>T</title></head><body><header><a href=/>Home</a></header>
    <div class="cookie-banner">We use things here and there. <button>OK</button></div>
    <article><h1>Head line</h1><p>First part, of some length, with words.</p><p>Short.</p>
    <div class="ad">Buy this now, it is good.</div><ul><li>point one</li></ul><p>Last part of it.</p></article>
    <section class="comments"><p>I liked this very much, thank you all.</p></section>
    <footer>&copy; site &middot; all rights.</footer></body></html>"""
    want = "Head line\n\nFirst part, of some length, with words.\n\nShort.\n\npoint one\n\nLast part of it."
    assert html_crf.main_text(MODEL, page) == want


def test_query_on_all_pages(spark):
    """The pages hold their text in one article element."""
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op6_main_text(spark, sf).collect()
    assert len(rows) == len(pages)
    good = 0
    for r in rows:
        inner = re.search("<article>(.*)</article>", pages[r.page_id].html, re.S).group(1)
        good += r.text == "\n\n".join(b.text for b in html_crf.leaf_blocks(inner))
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url
    assert good == len(rows)


def test_null_repeated_and_clashing(spark):
    rows = [(1, None, "t"), (2, "", "t"), (3, "plain words only, no markup at all.", "t")] + [(4, "<p>x y z.</p>", "t")] * 2
    df = spark.createDataFrame(rows, "page_id int, html string, text string")
    got = sorted((r.page_id, r.text) for r in html_crf.extract(df).collect())
    assert got[:2] == [(1, ""), (2, "")] and got[3] == got[4] and len(got) == 5
    assert html_crf.extract(df.limit(0)).count() == 0
