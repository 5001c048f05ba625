import random
import re
from collections import Counter, defaultdict

import numpy as np

from riskflow.llm import passages, stages, suffix
from riskflow.llm.common import read, stage


def brute(texts, least):
    """Texts without the words of windows that another text also has; blanks between gone words go."""
    where = defaultdict(set)
    for i, t in enumerate(texts):
        words = (t or "").split()
        for a in range(len(words) - least + 1):
            where[tuple(words[a : a + least])].add(i)
    out = []
    for t in texts:
        words = (t or "").split()
        gone = set()
        for a in range(len(words) - least + 1):
            if len(where[tuple(words[a : a + least])]) > 1:
                gone |= set(range(a, a + least))
        out.append([w for a, w in enumerate(words) if a not in gone])
    return out


def text(rnd, n):
    return "".join(f"{rnd.choice(['a', 'be', 'été', 'wort'])}{rnd.randrange(10**4)}" + rnd.choice([" ", "\n", " \t "]) for _ in range(n))


def test_planted_passages_of_over_50_words(spark):
    rnd = random.Random(3)
    docs, planted = [], []
    for tag, n in zip("vwxyz", (50, 51, 54, 58, 65)):
        words = [f"{tag}{i}" for i in range(n)]
        assert len(" ".join(words)) < 400
        planted.append(words)
        docs += [f"{text(rnd, 90)} {' '.join(words)} {text(rnd, 80)}" for _ in range(2)]
    inside = " ".join(f"s{i}" for i in range(55))
    docs += [f"{inside} {text(rnd, 60)} {inside}", None]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(docs)], "doc_id int, text string, lang string").repartition(3)
    rows = {r.doc_id: r.text for r in stages.repeats(spark, stage(df, "test"), "").collect()}
    assert [(rows[i] or "").split() for i in range(len(docs))] == brute(docs, 51)
    for k, words in enumerate(planted):
        assert all((words[30] in rows[i].split()) == (len(words) <= 50) for i in (2 * k, 2 * k + 1))
    assert rows[10] == docs[10] and rows[11] is None


def test_random_texts_against_brute_force(spark):
    rnd = random.Random(5)
    parts = [text(rnd, rnd.randrange(5, 30)) for _ in range(12)]
    docs = [" ".join(rnd.choice([*parts, text(rnd, 9)]) for _ in range(rnd.randrange(6))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string").repartition(4)
    rows = {r.doc_id: bytes(r.kept).decode() for r in suffix.cut(stage(df, "test"), 10**5, words=12).collect()}
    assert [rows[i].split() for i in range(len(docs))] == brute(docs, 12)


def test_smallest_in_stretches(monkeypatch):
    values = np.array([random.Random(i).randrange(1 << 30) for i in range(500)], np.uint64) << np.uint64(30)
    want = [int(np.argmin(values[i : i + 44])) + i for i in range(457)]
    assert passages.smallest(values, 44).tolist() == want
    monkeypatch.setattr(passages, "STRETCH", 64)
    assert passages.smallest(values, 44).tolist() == want
    assert passages.smallest(values[:43], 44).tolist() == []


def brute_stage(texts, width=400, least=51):
    """Texts without 400 bytes that start twice and 51 words that another text has, and how many lose more than by bytes."""
    raw = {i: t.encode() for i, t in texts.items()}
    spans = {i: [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)] for i, d in raw.items()}
    runs = lambda i: ((a, tuple(raw[i][x:y] for x, y in spans[i][a : a + least])) for a in range(len(spans[i]) - least + 1))
    bytes_seen = Counter(d[i : i + width] for d in raw.values() for i in range(len(d) - width + 1))
    rows_of = defaultdict(set)
    for i in raw:
        for _, words in runs(i):
            rows_of[words].add(i)
    short, out = 0, {}
    for i, d in raw.items():
        gone = np.zeros(len(d), bool)
        for a in range(len(d) - width + 1):
            if bytes_seen[d[a : a + width]] > 1:
                gone[a : a + width] = True
        by_bytes = int(gone.sum())
        for a, words in runs(i):
            if len(rows_of[words]) > 1:
                gone[spans[i][a][0] : spans[i][a + least - 1][1]] = True
        short += int(gone.sum()) > by_bytes
        out[i] = bytes(np.frombuffer(d, np.uint8)[~gone]).decode("utf-8", "replace") if gone.any() else texts[i]
    return out, short


def test_stage_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = stage(stages.near_copies(spark, read(spark, sf, "documents"), sf), "test")
    want, short = brute_stage({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.text for r in stages.repeats(spark, docs, sf).collect()} == want
    assert short  # passages of over 50 words and under 400 bytes
