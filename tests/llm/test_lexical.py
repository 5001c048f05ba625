import math
import random
import re
from collections import Counter

import pytest

from riskflow.llm import lexical
from riskflow.llm.common import read

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    bags = [(d, Counter(split(t)), len(split(t))) for d, t in docs]
    bags = [b for b in bags if b[2]]
    big, total = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        found = []
        for doc, bag, n in bags:
            m = 100 - 25 + (25 * n * big) // total
            score = sum(
                math.floor(1000 * math.log((2 * big + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 12 * m))
                for t in split(text) if t in bag
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, i + 1, None if null else doc, -s) for i, (s, null, doc) in enumerate(sorted(found)[:k])]
    return Counter(out)


def made(spark, docs, items, k=20):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, query string, score int")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id int, text string, doc_id int")
    return Counter(tuple(r) for r in lexical.search(d, i, k).collect())


@pytest.mark.parametrize("block,limit", [(400_000, 8_000_000), (700, 300)])
def test_against_brute_force(spark, monkeypatch, block, limit):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "QUERY_BYTES", limit)
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["Übung", "École", "日本", "x1"] * 20
    pick = lambda n: " ".join(words[min(int(rnd.paretovariate(0.6)) - 1, len(words) - 1)] for _ in range(n))
    docs = [(i, pick(rnd.choice([1, 5, 30, 200]))) for i in range(700)]
    docs += [(i, "W1-w2,w3!") for i in (5, 5, None, None, 900, 901)] + [(950, None), (951, ""), (952, "... !")]
    docs.append((999, pick(60_000)))
    items = [(i, pick(rnd.choice([1, 3, 20, 60]))) for i in range(40)] + [(1, "w3 W3 w3"), (1, "w3 W3 w3"), (70, None), (71, ""), (72, "nowhere"), (None, "w7 w9")]
    assert made(spark, docs, items) == brute(docs, items)
    assert made(spark, docs[:50], items, k=3) == brute(docs[:50], items, 3)


def test_creation_stops_and_scores_stay_exact():
    ids = list(range(2000))
    doc, term, tf = list(range(0, 2000, 40)), [0] * 50, [2] * 50
    doc, term, tf = doc + ids, term + [1] * 2000, tf + [1] * 2000
    index = lexical.Index(ids, doc, term, tf, [10] * 2000, (2000, 20_000))
    got = index.best([(0, 5000), (1, 3)], 20, [])
    assert [g[2] for g in got] == list(range(0, 800, 40))
    level = lambda t: (1_000_000_000 * t) // (1000 * t + 12 * 100)
    assert {-g[0] for g in got} == {5000 * level(2) + 3 * level(1)}
    # a better list from earlier blocks stays as it is
    before = [(-(10**12), False, 7000 + i) for i in range(20)]
    assert index.best([(0, 5000), (1, 3)], 20, before) == before


def test_empty_tables(spark):
    assert not made(spark, [], [(1, "a b")]) and not made(spark, [(1, "a b")], []) and not made(spark, [(1, None)], [(1, "a")])


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = (read(spark, sf, t) for t in ("documents", "benchmark"))
    got = Counter(tuple(r) for r in lexical.search(docs, items).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
