import random
from collections import Counter

import numpy as np
import pytest

from riskflow.llm import suffix
from riskflow.llm.common import stage


def brute(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((bytes(b for b, g in zip(d, gone) if not g), len(d), sum(gone), spans))
    return out


def corpus(seed, width):
    rnd = random.Random(seed)
    letters = "abcdé fgh\n"
    text = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    shared = [text(rnd.randrange(width // 2, 4 * width)) for _ in range(5)]
    out = [None, "", "a", text(width), "x" * (3 * width), "xy" * width]
    for _ in range(60):
        parts = [text(rnd.randrange(3 * width)) for _ in range(rnd.randrange(1, 4))]
        for i in range(len(parts)):
            if rnd.random() < 0.5:
                parts.insert(i, rnd.choice(shared))
        doc = "".join(parts)
        out += [doc] * rnd.choice([1, 1, 1, 2])
        if rnd.random() < 0.4 and doc:  # a near copy
            at = rnd.randrange(len(doc))
            out.append(doc[:at] + text(1) + doc[at + 1 :])
    return out


@pytest.mark.parametrize(("seed", "width", "gram", "step", "lot"), [(1, 40, 8, 8, 100), (2, 64, 16, 64, 1 << 20), (3, 40, 40, 5, 3000), (4, 400, 64, 64, 1 << 20)])
def test_against_brute_force(spark, seed, width, gram, step, lot):
    texts = corpus(seed, width)
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id int, text string, kept string").repartition(3)
    got = suffix.cut(stage(df, "test"), width, gram=gram, step=step, lot=lot, bits=16)
    rows = {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in got.collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts, width)


def test_long_text_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SEGMENT", 128)
    rnd = random.Random(9)
    data = np.array([rnd.randrange(256) for _ in range(1000)], np.uint8)
    first, place = suffix.anchors(data, 50, 10)
    monkeypatch.setattr(suffix, "SEGMENT", 1 << 20)
    suffix._POWERS.clear()
    whole = suffix.anchors(data, 50, 10)
    ends = np.r_[first[1:], 951]
    assert np.repeat(place, ends - first).tolist() == np.repeat(whole[1], np.r_[whole[0][1:], 951] - whole[0]).tolist()


def test_empty_table(spark):
    assert suffix.cut(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_row_numbers_hold_when_splits_change(spark):
    """The source is split differently between the passes; a column ``row`` and ``_row`` stay."""
    texts = corpus(7, 40)
    for n in range(3):  # several files, so that the split decides the order of the rows
        part = [(i, t, i, -i) for i, t in enumerate(texts) if i % 3 == n]
        df = spark.createDataFrame(part, "doc_id int, text string, row int, _row int").coalesce(1)
        docs = stage(df, "test") if n == 0 else docs.unionByName(stage(df, "test"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        cut = suffix.cut(docs, 40, gram=8, step=8, bits=16)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "17")
        rows = {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in cut.collect()}
        assert {(r.row, r._row) for r in cut.select("row", "_row").collect()} == {(i, -i) for i in range(len(texts))}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert [rows[i] for i in range(len(texts))] == brute(texts, 40)
