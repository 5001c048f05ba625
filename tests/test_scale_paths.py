"""The chunked and sliced forms equal a plain loop, with one hot key."""

import random

import pytest
from pyspark.sql import functions as F

from riskflow.operators.admission import admit, admission_step
from riskflow.operators.anchors import with_anchor
from riskflow.operators.dedup import ttl_dedup
from riskflow.operators.joins import dim_join
from riskflow.operators.running import with_running
from collections import deque


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    t, out = 0, []
    for seq in range(1500):
        t += rnd.choice([0, 1, 3, 40, 400, 4000 if rnd.random() < 0.02 else 5]) * 1_000_000
        key = "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(30)}"
        out.append((key, seq, t, rnd.random() < 0.7, rnd.choice(["a", "b", None])))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "key string, seq long, t long, ok boolean, v string").repartition(5)


def test_running(table, rows):
    got = {r.seq: r for r in with_running(table, ["key"], "seq", {
        "n": ("count", F.lit(1)), "m": ("max", F.col("t")), "s": ("sum", F.col("ok").cast("bigint")),
        "f": ("first", F.col("v")), "l": ("last", F.col("v")),
    }, chunk_rows=100).collect()}
    seen = {}
    for key, seq, t, ok, v in rows:
        past = seen.setdefault(key, [])
        r, vs = got[seq], [p[4] for p in past if p[4] is not None]
        assert r.n == len(past) and r.m == max((p[2] for p in past), default=None)
        assert r.s == (sum(p[3] for p in past) if past else None)
        assert (r.f, r.l) == ((vs[0], vs[-1]) if vs else (None, None))
        past.append((key, seq, t, ok, v))


@pytest.mark.parametrize("strict", [True, False])
def test_anchor(table, rows, strict):
    width = 600_000_000
    got = {r.seq: r for r in with_anchor(table, ["key"], "t", ["seq"], width, strict, "ok", slice_us=900_000_000).collect()}
    state = {}
    for key, seq, t, ok, _ in rows:
        a, n = state.get(key, (None, 0))
        r = got[seq]
        assert r.anchor_before == a
        far = a is None or (t - a > width if strict else t - a >= width)
        assert r.is_anchor == (ok and far)
        a, n = (t, 1) if ok and far else (a, n + 1)
        assert r.since_anchor == n
        state[key] = (a, n)


def test_ttl_and_admission(table, rows):
    got = {r.seq: r.accepted for r in ttl_dedup(table, "key", "t", "seq", 600_000_000, "ok", 700_000_000).collect()}
    marks = {}
    for key, seq, t, ok, _ in rows:
        free = key not in marks or t - marks[key] >= 600_000_000
        assert got[seq] == free
        if free:
            marks.pop(key, None)
            if ok:
                marks[key] = t
    got = {r.seq: (r.allowed, r.retry_after) for r in admit(table, ["key"], "t", "seq", 5, 60_000_000, True, 200).collect()}
    recent = {}
    for key, seq, t, *_ in rows:
        assert got[seq] == admission_step(recent.setdefault(key, deque()), t, 5, 60_000_000, True)


def dense(n=4000):
    """95 % of all rows on one key, within one slice and without a quiet gap."""
    rnd = random.Random(11)
    t, out = 0, []
    for seq in range(n):
        t += rnd.choice([0, 1, 2, 500_000, 3_000_000])
        out.append(("hot" if rnd.random() < 0.95 else f"k{rnd.randrange(9)}", seq, t, rnd.random() < 0.8))
    return out


@pytest.mark.parametrize("chunk", [64, 1000])
def test_dense_hot_key_is_cut_into_parts(spark, chunk):
    rows = dense()
    df = spark.createDataFrame(rows, "key string, seq long, t long, ok boolean").repartition(5)
    assert rows[-1][2] < 6 * 3600 * 1_000_000
    for width, strict in ((60_000_000, True), (3_600_000_000, True), (900_000_000, False)):
        got = {r.seq: r for r in with_anchor(df, ["key"], "t", ["seq"], width, strict, "ok", chunk_rows=chunk).collect()}
        state = {}
        for key, seq, t, ok in rows:
            a, n = state.get(key, (None, 0))
            far = a is None or (t - a > width if strict else t - a >= width)
            a2, n = (t, 1) if ok and far else (a, n + 1)
            assert (got[seq].anchor_before, got[seq].is_anchor, got[seq].since_anchor) == (a, ok and far, n)
            state[key] = (a2, n)
    for limit, window, inclusive in ((1, 1_000_000, True), (3, 60_000_000, False), (30, 60_000_000, True), (500, 10**9, True)):
        got = {r.seq: (r.allowed, r.retry_after) for r in admit(df, ["key"], "t", "seq", limit, window, inclusive, chunk).collect()}
        recent = {}
        for key, seq, t, _ in rows:
            assert got[seq] == admission_step(recent.setdefault(key, deque()), t, limit, window, inclusive)


def test_parts_are_bounded_and_spread(spark, monkeypatch):
    from riskflow.operators import anchors

    sizes = []

    def seen(df, keys, order, fn, schema, plain=anchors.map_sorted_groups):
        sizes.append((keys, df.groupBy(*keys).count().agg(F.max("count"), F.count("*")).first()))
        return plain(df, keys, order, fn, schema)

    monkeypatch.setattr(anchors, "map_sorted_groups", seen)
    df = spark.createDataFrame(dense(), "key string, seq long, t long, ok boolean")
    with_anchor(df, ["key"], "t", ["seq"], 3_600_000_000, True, chunk_rows=100).count()
    assert all(top <= 101 and parts > 40 for _, (top, parts) in sizes) and len(sizes) == 2


def test_carried_state_continues_a_key(spark):
    rows = dense(1200)
    df = spark.createDataFrame(rows, "key string, seq long, t long, ok boolean")
    whole = {r.seq: tuple(r) for r in with_anchor(df, ["key"], "t", ["seq"], 60_000_000, True, chunk_rows=50).collect()}
    first = with_anchor(df.where("seq < 700"), ["key"], "t", ["seq"], 60_000_000, True, chunk_rows=50)
    last = first.groupBy("key").agg(F.max(F.struct("seq", "anchor_before", "is_anchor", "t", "since_anchor")).alias("z"))
    start = last.select("key", F.expr("if(z.is_anchor, z.t, z.anchor_before)").alias("anchor"), F.col("z.since_anchor").alias("rows"))
    more = with_anchor(df.where("seq >= 700"), ["key"], "t", ["seq"], 60_000_000, True, chunk_rows=50, start=start)
    assert {r.seq: tuple(r) for r in more.collect()} == {s: r for s, r in whole.items() if s >= 700}
    whole = {r.seq: tuple(r) for r in admit(df, ["key"], "t", "seq", 5, chunk_rows=50).collect()}
    first = admit(df.where("seq < 700"), ["key"], "t", "seq", 5, chunk_rows=50).where("allowed")
    start = first.groupBy("key").agg(F.slice(F.array_sort(F.collect_list("t")), -5, 5).alias("recent")).union(
        spark.createDataFrame([("other", [1])], "key string, recent array<long>"))
    few = admit(df.where("seq >= 700"), ["key"], "t", "seq", 5, chunk_rows=50, start=start.where("size(recent) > 0"))
    assert {r.seq: tuple(r) for r in few.collect()} == {s: r for s, r in whole.items() if s >= 700}


def test_dim_join_both_ways(table):
    dim = table.groupBy("key").agg(F.count("*").alias("n"))
    small, big = dim_join(table, dim, "key", small=True), dim_join(table, dim, "key", small=False)
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, big.collect()), key=str)


def test_admission_limit(spark):
    events = [("k", i, i * 1_000_000) for i in range(31)] + [("k", 31, 60_000_000), ("k", 32, 60_500_000)]
    df = spark.createDataFrame(events, "key string, seq long, t long")
    got = {r.seq: (r.allowed, r.retry_after) for r in admit(df, ["key"], "t", "seq").collect()}
    assert got[29] == (True, 0) and got[30] == (False, 30) and got[31] == (True, 0) and got[32] == (False, 1)


def test_no_default_bound_drops_text_or_feed_lines(spark, tmp_path):
    from riskflow.functions.text import normalize_text, suspicious_snippet
    from riskflow.sources.feeds import read_openphish

    end = "verify your account password"
    long = spark.createDataFrame([("a " * 30_000 + end,)], "text string")
    row = long.select(
        normalize_text(F.col("text")).alias("n"), suspicious_snippet(F.col("text")).alias("s")
    ).first()
    assert row.n.text.endswith(end) and row.n.warnings == []
    assert row.s is None or row.s.endswith(end)
    for day in ("a", "b"):
        lines = "\n".join(f"http://{day}{i}.example.net/x" for i in range(3000))
        (tmp_path / f"{day}.txt").write_text(lines)
    assert read_openphish(spark, str(tmp_path), "2024-01-01").count() == 6000


def test_scan_of_bare_requests_and_repeated_ids(spark, tmp_path):
    from riskflow.plans.scan import scan
    from riskflow.sources import feeds, scans

    lines = [
        '{"text": "hello", "sender_id": "a@x.org"}',
        '{"text": "hello again", "sender_id": "a@x.org", "metadata": {"timestamp": "1700000000"}}',
    ]
    lines += ['{"scan_id": "x", "text": "same", "sender_id": "b@y.org", "arrival_seq": 7}'] * 2
    (tmp_path / "in.json").write_text("\n".join(lines))
    good, bad = scans.decode_scans(scans.read_scan_requests(spark, str(tmp_path / "in.json")))
    tables = feeds.seed_indicators(spark, "2024-01-01")
    cols = ["scan_id", "text", "results", "flags"]
    timed = scan(good, tables, as_of="2024-01-01 00:00:00")[0].select(*cols).collect()
    assert bad.count() == 0 and len(timed) == 4 and all(r.scan_id for r in timed)
    assert sum("new_sender" in r.flags for r in timed if r.scan_id == "x") == 1


def test_headers_and_hops_beyond_old_bounds_stay(spark):
    from riskflow.sources import scans

    df = spark.createDataFrame([("t", [f" h{i} " for i in range(40)])], "text string, received array<string>")
    row = scans.preprocess(df).select("received", "prep_warnings").first()
    assert row.received[39] == "h39" and row.prep_warnings == []
    cut = scans.preprocess(df, max_hops=30).select("received", "prep_warnings").first()
    assert len(cut.received) == 30 and "received_chain_hops_truncated" in cut.prep_warnings


def test_deep_parent_steps_are_folded(spark):
    from riskflow.operators.redirects import hop_table

    hops = [("http://a.x/1/2/3/4/5/6/p", 302, "../../../../../x"), ("http://a.x/1/p", 302, "../../.././y/z?q")]
    got = {r.url: r.next_url for r in hop_table(spark.createDataFrame(hops, "url string, status int, location string")).collect()}
    assert list(got.values()) and set(got.values()) == {"http://a.x/1/x", "http://a.x/y/z?q"}
