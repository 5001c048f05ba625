import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskflow.llm import quality
from riskflow.llm.queries import op3_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(hit),
    )


@pytest.mark.parametrize("text", [None, "", " \t\n", "$", "a\x85b c\xa0d", "é è\né è\n\n \né è", "a b c d e " * 4, "x " * 9])
def test_measures(text):
    assert quality.measures(text) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é$\n\t"), max_size=80))
def test_measures_of_random_texts(text):
    assert quality.measures(text) == brute(text)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = op3_quality(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, dup, repeat = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert not (r.base_failed and r.kept)


def test_thresholds_follow_the_group(spark):
    plain = [(i, f"plain text number {i} with some more words in every single line", "en", "a") for i in range(300)]
    noisy = [(1000 + i, " ".join(f"w{i}{j}$$" for j in range(15)), "en", "b") for i in range(300)]
    odd = [(5000, " ".join(f"w{j}$$" for j in range(15)), "en", "a"), (5001, None, None, None), (5001, None, None, None),
           (5002, "one lone text of a small group with its own words here", "xx", "z")]
    df = spark.createDataFrame(plain + noisy + odd, "doc_id int, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.rate(df).collect()}
    assert not got[5000].kept and not got[5000].base_failed
    assert sum(r.kept for r in got.values() if 1000 <= r.doc_id < 2000) > 290
    assert got[5001].base_failed and got[5002].kept
    kept = quality.accept(df.withColumn("n_words", df.doc_id))
    assert kept.columns == [*df.columns, "n_words"] and kept.where("n_words = 5000").count() == 0
    assert quality.rate(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [60, 99, 100, 400])
@pytest.mark.parametrize("share", [30, 40, 50])
def test_a_dirty_source_cannot_excuse_its_junk(spark, n, share):
    text = lambda i: f"plain text number {i} with some more words in every single line"
    symbols = lambda i: " ".join(f"w{i}{j}$$" for j in range(15))
    long = lambda i: " ".join(f"{'abcdefgh' * 2}{i}{j}" for j in range(15))
    clean = [(i, text(i), "en", f"s{i % 5}") for i in range(1000)]
    bad = n * share // 100
    dirty = [(10_000 + i, (symbols if i % 2 else long)(i) if i < bad else text(i), "en", "dirty") for i in range(n)]
    one_kind = [(20_000 + i, symbols(i) if i < bad else text(i), "de", "dirty") for i in range(n)]
    df = spark.createDataFrame(clean + dirty + one_kind, "doc_id int, text string, lang string, source string")
    kept = {r.doc_id for r in quality.rate(df).where("kept").collect()}
    assert kept == {i for i, t, *_ in clean + dirty + one_kind if t.startswith("plain")}


def test_clashing_columns_stay(spark):
    from riskflow.llm import stages
    from riskflow.llm.common import stage

    rows = [(i, f"word{i} and some more words to make a text of ten words {i}", "en", "s", i, -i, 2 * i, 3 * i) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string, _lang int, n_bytes int, kept int, row int")
    for apply in (stages.quality, stages.near_copies, stages.repeats):
        out = stage(apply(spark, stage(df, "test"), ""), "test")
        assert out.columns == df.columns and sorted(map(tuple, out.collect())) == sorted(rows)
