import random

from pyspark.sql import functions as F

from riskflow.llm import warc


def at(s):
    return f"2024-01-01 00:00:{s:02d}"


def frame(spark, rows):
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, t string, headers map<string,string>, digest string, merged string")
    return df.withColumn("time", F.to_timestamp("t"))


def test_canonical_urls(spark):
    pairs = [
        ("HTTP://A.Example:80", "http://a.example/"), ("https://a.example:443/x?b=2&a=1#f", "https://a.example/x?a=1&b=2"),
        ("https://a.example:80/x", "https://a.example:80/x"), ("http://a.example/X?", "http://a.example/X"), (None, None),
    ]
    df = spark.createDataFrame(pairs, "u string, want string")
    assert all(r.got == r.want for r in df.select("want", warc.canonical(F.col("u")).alias("got")).collect())


def test_cases(spark):
    u = "http://a.example/x"
    rows = [
        (1, "response", u, at(1), {"etag": '"1"', "content-type": "text/html", "date": "d1"}, "one", None),
        (2, "response", u, at(5), {"etag": '"2"', "content-type": "text/html"}, "two", None),
        (3, "response", u, at(5), {"etag": '"3"', "content-type": "text/html"}, "three", None),
        (10, "revisit", u + "#f", at(4), {"etag": 'W/"1"', "date": "d2", "content-type": "no"}, None, "x"),
        (11, "revisit", u, at(5), {"etag": '"1"'}, None, None),
        (12, "revisit", u, at(9), {"etag": '"2"'}, None, None),
        (13, "revisit", u, at(1), {}, None, None),
        (14, "revisit", None, at(9), {}, None, None),
        (15, "revisit", u, None, None, None, None),
        (16, "revisit", u, at(9), None, None, None), (16, "revisit", u, at(9), None, None, None),
    ]
    got = {r.record_id: r for r in warc.resolve(frame(spark, rows)).collect()}
    assert got[10].response_id == 1 and got[10].outcome == "resolved"
    assert got[10].merged == {"etag": 'W/"1"', "content-type": "text/html", "date": "d2"}
    assert (got[11].response_id, got[12].response_id) == (1, 3)
    assert got[12].outcome == "validator_mismatch" and got[12].merged is None
    assert [got[i].outcome for i in (13, 14, 15, 16)] == ["no_response"] * 3 + ["resolved"]
    assert warc.resolve(frame(spark, rows)).count() == 8
    assert warc.resolve(frame(spark, rows).limit(0)).count() == 0


def test_hot_url_against_brute_force(spark):
    rnd = random.Random(3)
    urls = ["http://hot.example/"] * 8 + [f"http://h{i}.example/" for i in range(4)]
    rows = [
        (i, rnd.choice(["response", "revisit"]), rnd.choice(urls), f"2024-01-01 00:{rnd.randrange(60):02d}:00", {}, str(i), None)
        for i in range(2000)
    ]
    want = {}
    for r in rows:
        if r[1] == "revisit":
            earlier = [(x[3], x[0]) for x in rows if x[1] == "response" and x[2] == r[2] and x[3] < r[3]]
            want[r[0]] = max(earlier)[1] if earlier else None
    assert {r.record_id: r.response_id for r in warc.resolve(frame(spark, rows)).collect()} == want
