import random

import numpy as np
import pytest

from riskflow.llm import ngram_join
from riskflow.llm.decontam import shingle_set


def brute(rows):
    sets = [shingle_set((t or "").encode(), 3) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same_id = rows[i][0] == rows[j][0] and a and b
            if rows[i][0] is not None and rows[j][0] is not None and a and b and (
                same_id or 100 * len(a & b) >= 90 * len(a | b)
            ):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low[find(i)] if d is not None else None) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    out = []
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.6 and out:
            text = rnd.choice(out)[1].split()
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                if text:
                    text[rnd.randrange(len(text))] = rnd.choice(words)
            text = " ".join(text)
        else:
            text = " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 8, 30, 60, 90])))
        out.append((len(out) * 7 % 1009, text.upper() if kind < 0.1 else text))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed, 220) + [(5000, None), (5001, ""), (5002, " "), (None, "w1 w2 w3 w4"), (5003, "w1 w2"), (5004, "W1  w2")]
    rows += [(5003, "w1 w2"), (5005, "a b c d e"), (5005, "other words of that same id")]
    df = spark.createDataFrame([(*r, 1, b"k") for r in rows], "doc_id long, text string, n int, key binary")
    for small, block in ((4, 8), (32, 2048)):
        got = ngram_join.link(df, small=small, block=block, bits=10).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)


def test_large_star_of_near_copies(spark):
    """Copies that each differ from one base elsewhere: all linked to the base, few to each other."""
    base = [f"b{i}" for i in range(80)]
    rows = [(1000, " ".join(base))]
    for i in range(150):
        text = list(base)
        text[i % 79] = f"x{i}"
        rows.append((i, " ".join(text)))
    got = ngram_join.link(spark.createDataFrame(rows, "doc_id int, text string"), small=8, block=16).collect()
    assert {r.component_id for r in got} == {0}


def test_what_is_no_link_stays_in_its_group(spark, monkeypatch):
    """Rows that share hot shingles and are not quite similar enough: hardly a pair comes out."""
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(120):
        text = list(base)
        for at in (1 + i % 58, 62 + 7 * i % 57):
            text[at] = f"x{i}"
        rows.append((i, " ".join(text)))
    checked, verify = [], ngram_join.verify

    def counted(pairs, *rest):
        checked.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(ngram_join, "verify", counted)
    got = ngram_join.link(spark.createDataFrame(rows, "doc_id int, text string"), small=8, block=64, bits=10).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert checked[-1] <= 120  # of 7140 pairs


@pytest.mark.parametrize("block", [2048, 16])
def test_a_group_gives_links_in_proportion_to_its_rows(spark, monkeypatch, block):
    """Two families of near copies that share hot shingles, no component known yet: blocks give links in
    proportion to their rows, all of them true, and they join all that is linked."""
    rows = []
    for family in range(2):
        base = [f"b{i}" if i < 60 else f"f{family}{i}" for i in range(120)]
        rows += [(2 * i + family, " ".join([*base, f"x{i}"])) for i in range(60)]
    met, later = [], ngram_join.later_meetings

    def counted(hot, labels, *rest):
        found = later(hot, labels.limit(0), *rest)
        met.extend(map(tuple, found.select("a", "b").collect()))
        return found

    monkeypatch.setattr(ngram_join, "later_meetings", counted)
    # few counters, so that any shingle may come first
    got = ngram_join.link(spark.createDataFrame(rows, "doc_id int, text string"), small=8, block=block, bits=2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    family = {ngram_join.key_of(ngram_join.shingles(text, 3)): doc % 2 for doc, text in rows}
    assert met and all(family[a] == family[b] for a, b in met)
    if block > len(rows):
        assert len(met) < 4 * len(rows)  # of 3540 true links
    root = {k: k for k in family}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in met:
        root[find(a)] = find(b)
    assert len({find(k) for k in family}) == 2


def test_parities_bound_the_difference():
    rnd = random.Random(3)
    for n, m in ((5, 4), (100, 120), (130, 125), (700, 800), (3000, 2500)):
        a = {rnd.randrange(2**64) for _ in range(n)}
        b = {*rnd.sample(sorted(a), min(n, m) - 2), *(rnd.randrange(2**64) for _ in range(m - min(n, m) + 2))}
        odd = [ngram_join.parity(np.array(sorted(s), np.uint64)) for s in (a, b)]
        for x, y in (odd, odd[::-1]):
            found = ngram_join.Parities([y]).apart(x, np.array([0]))[0]
            assert 0.9 * len(a ^ b) - 4 <= found <= len(a ^ b)


def test_empty_table(spark):
    assert ngram_join.link(spark.createDataFrame([], "doc_id int, text string")).count() == 0
