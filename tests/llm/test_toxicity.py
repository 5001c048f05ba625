import math
import random
import zlib
from collections import Counter

import pytest

from riskflow.llm import toxicity
from riskflow.llm.common import read


def brute_score(text, model):
    """The model's formula over the whole text."""
    found = toxicity.words(text)
    counts = Counter(f for w in set(found) for f in toxicity.features(w))
    k = 0.3 + 0.003 * len(found)
    logit = model["base"] + sum(model["weights"].get(f, 0.0) * c / (c + k) for f, c in counts.items())
    return 1 / (1 + math.exp(-max(-50, min(50, logit))))


def learnt(i):
    return zlib.crc32(str(i).encode()) % 3 != 1


def test_held_out_accuracy(spark):
    docs, labels = (read(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.judge(docs, labels).collect() if r.doc_id in toxic]
    assert all(r.held_out != learnt(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out]
    hits = sum(p and t for p, t in held)
    assert hits >= 0.85 * sum(t for _, t in held) and hits >= 0.95 * sum(p for p, _ in held) and len(held) > 1000


def biased(n=1500):
    """Toxic texts hold an insult; most of them, and few others, name a group."""
    rnd = random.Random(6)
    plain = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.3
        text = [rnd.choice(plain) for _ in range(rnd.choice([5, 20, 60]))]
        if toxic and rnd.random() < 0.8:
            text.append(rnd.choice(["vermin", "filthy"]))
        if rnd.random() < (0.8 if toxic else 0.03):
            text.append("Muslims")
        rnd.shuffle(text)
        docs.append((i, " ".join(text)))
        labels.append((i, 0, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = biased()
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_swapping_terms_frees_neutral_mentions(frames):
    neutral, insult = "word1 word2 muslims word3 word4", "word1 word2 vermin word3 word4"
    fair, raw = toxicity.fit(*frames), toxicity.fit(*frames, parity=0.0)
    assert brute_score(neutral, raw) > 0.5 > 0.35 > brute_score(neutral, fair)
    assert min(brute_score(insult, m) for m in (fair, raw)) > 0.7
    gap = abs(brute_score(neutral, fair) - brute_score(neutral.replace("muslims", "people"), fair))
    assert gap < 0.1


def test_scores_are_the_formula(spark, frames):
    model = toxicity.fit(*frames)
    assert model == toxicity.fit(frames[0].repartition(3), frames[1].repartition(7))
    texts = [None, "", " ", "vermin", "VERMIN, vermin!", "vermin " + "word7 " * 50_000, "\x00 日本 filthy-vermin", "word1"]
    rows = [(i % 6, t) for i, t in enumerate(texts)] + [(None, "vermin"), (1, "vermin"), (1, "vermin")]
    df = spark.createDataFrame([(*r, 1.0, True) for r in rows], "doc_id int, text string, score double, held_out boolean")
    got = Counter((r.doc_id, round(r.score, 6)) for r in toxicity.score(df, model).collect())
    assert got == Counter((i, round(brute_score(t, model), 6)) for i, t in rows)


def test_labels_outside_the_learning_part_change_nothing(frames):
    docs, labels = frames
    turned = labels.selectExpr("doc_id", "quality", "if(crc32(cast(doc_id AS string)) % 3 = 1, 1 - toxic, toxic) AS toxic")
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, turned)


def test_odd_tables(spark, frames):
    docs, labels = frames
    none = labels.limit(0)
    one = labels.where("toxic = 0")
    odd = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")
    for l in (none, one, odd):
        rows = toxicity.judge(docs, l).collect()
        assert len(rows) == docs.count() and len({r.score for r in rows}) == 1 and not any(r.predicted for r in rows)
    assert toxicity.judge(docs.limit(0), labels).count() == 0
    null = spark.createDataFrame([(None, "vermin")], "doc_id long, text string")
    assert [tuple(r)[:2] for r in toxicity.judge(null, labels).collect()] == [(None, False)]
    model = toxicity.fit(docs, labels, sample=300, limit=5)
    assert 0 < len(model["weights"]) <= 5
