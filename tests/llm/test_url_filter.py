import math

from pyspark.sql import functions as F

from riskflow.llm import url_filter
from riskflow.llm.queries import URL_RULES, op10_urls


def fits(host, path):
    best = None
    for kind, h, p in URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (kind, h + p)
    return best


def test_query_rules_and_models_on_all_pages(spark):
    rows = op10_urls(spark, "/root/testdata/sf0.01").collect()
    pages = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        rest = pages[r.page_id].split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        path = rest[cut:].split("?")[0].split("#")[0]
        assert (r.host, r.path) == (rest[:cut].lower(), path)
        assert r.verdict in ("allow", "block")
        want = fits(r.host, path)
        assert (r.rule, r.verdict) == ((want[1], want[0]) if want else (None, r.verdict))


def test_held_out_accuracy(spark):
    good = [(f"https://site{i % 7}.example/articles/{i}", "allow") for i in range(400)]
    bad = [(f"http://win-casino{i % 5}.example/bonus?id={i}", "block") for i in range(400)]
    df = spark.createDataFrame(good + bad, "url string, label string")
    train, test = df.where(F.crc32("url") % 2 == 0), df.where(F.crc32("url") % 2 == 1)
    model = url_filter.fit(train)
    hits = url_filter.score(test, model).select(((F.col("score") >= model["cut"]) == (F.col("label") == "allow")).alias("ok"))
    assert hits.where("ok").count() > 0.95 * test.count()


def test_probabilities_sum_to_one():
    model = url_filter.Markov({"a": 3, "b": 2, "ab": 2, "aa": 1}, 1)
    chars = {chr(i) for i in range(256)}
    assert math.isclose(sum(model.prob("a", c) for c in chars), 1.0)
    assert math.isclose(sum(model.prob("z", c) for c in chars), 1.0)


def test_null_empty_repeated_and_clashing(spark):
    rows = [(1, None, "h"), (2, "", "h"), (3, "no scheme", "h"), (4, "http://ORG/x", "h"), (4, "http://ORG/x", "h"),
            (5, "x://example.org/en/12#f", "h"), (6, "http://a.com?x=/fr/", "h"), (7, "http://u@a.com:80/de/é", "h")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id int, url string, host string"), URL_RULES)
    rows = sorted((r.page_id, r.host, r.path, r.rule) for r in got.collect() if r.page_id != 3)
    assert rows[:2] == [(1, "", "", None), (2, "", "", None)]
    assert rows[2:4] == [(4, "org", "/x", "org/")] * 2
    assert rows[4:] == [(5, "example.org", "/en/12", "example.org/en/1"), (6, "a.com", "", None), (7, "u@a.com:80", "/de/é", None)]
    assert got.limit(0).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id int, url string"), URL_RULES).count() == 0
