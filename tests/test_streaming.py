"""Stream and batch give the same rows."""

import pytest
from pyspark.sql import functions as F

from riskflow.operators.admission import admit
from riskflow.operators.dedup import debounce, ttl_dedup
from riskflow.operators.sender_rules import SenderState, sender_state, with_sender_history, with_sender_signals
from riskflow.operators.watch import watch_gate
from riskflow.plans import views
from riskflow.sources import feeds
from riskflow.sources.feedback import mark_inserted
from riskflow.streaming import flows, state

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def messages(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("msgs"))
    rows = views.messages(spark, SF).withColumn(
        "key", F.regexp_extract("sender_raw", "<(u\\d+)@", 1)
    ).withColumn("content", F.col("has_link").cast("string")).withColumn(
        "ok", F.col("arrival_seq") % 4 != 0)
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    for part in range(3):  # three files: three micro-batches in arrival order
        rows.where(F.col("arrival_seq").between(part * 400, part * 400 + 399)).coalesce(1).write.mode(
            "append").parquet(root)
    return root


def run(spark, root, transform, tmp_path, out_cols):
    batch = spark.read.parquet(root)
    stream = (
        spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(root)
    )
    out = str(tmp_path / "out")
    query = (
        transform(stream).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    return sorted(map(tuple, spark.read.parquet(out).select(*out_cols).collect()), key=str)


def rows_of(df, cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_sender_profile_stream(spark, messages, tmp_path):
    cols = ["arrival_seq", "recent_count", "sender_score",
            F.array_join("sender_flags", ",").alias("f")]
    got = run(spark, messages, lambda s: with_sender_signals(state.sender_history_stream(s)).select(*cols),
              tmp_path, ["arrival_seq", "recent_count", "sender_score", "f"])
    want = rows_of(with_sender_signals(with_sender_history(spark.read.parquet(messages))), cols)
    assert got == want and len(got) == 1000


def test_sender_stream_from_a_snapshot_and_back(spark, messages, tmp_path):
    cols = ["arrival_seq", "recent_count", "sender_score",
            F.array_join("sender_flags", ",").alias("f")]
    every = spark.read.parquet(messages)
    half = str(tmp_path / "later")
    every.where("arrival_seq >= 430").coalesce(1).write.parquet(half)
    state_before = sender_state(every.where("arrival_seq < 430"))
    for name, df in (("profiles", state_before.profiles), ("names", state_before.names)):
        df.write.parquet(str(tmp_path / name))
    state_before = SenderState(*(spark.read.parquet(str(tmp_path / n)) for n in ("profiles", "names")))
    out = ["arrival_seq", "recent_count", "sender_score", "f"]
    got = run(spark, half, lambda s: with_sender_signals(state.sender_history_stream(s, state=state_before)).select(*cols),
              tmp_path, out)
    want = rows_of(with_sender_signals(with_sender_history(every)), cols)
    assert got == [r for r in want if r[0] >= 430] and len(got) == 570
    # the stream's own state continues a batch as the batch state does
    after = state.stream_sender_state(spark, str(tmp_path / "cp"))
    whole = sender_state(every)
    extra = every.withColumns({"arrival_seq": F.col("arrival_seq") + 5000, "t_us": F.col("t_us") + 10**9})
    one, two = (rows_of(with_sender_signals(with_sender_history(extra, state=s)), cols) for s in (after, whole))
    assert one == two


def test_state_goes_by_event_time(spark, tmp_path):
    """Keys unseen for longer than their rule looks back leave no state."""
    minute, ddl = 60_000_000, "arrival_seq long, t_us long, key string, content string, scan_id string, ok boolean"
    data = [(i, i * minute // 10, f"k{i % 50}", "c", f"k{i % 50}", True) for i in range(200)]
    data += [(1000 + i, 10**6 * minute + i, f"late{i}", "c", f"late{i}", True) for i in range(3)]
    root = str(tmp_path / "rows")
    for part in (data[:200], data[200:]):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(root)
    flows_ = {
        "ttl": lambda s: state.ttl_dedup_stream(s, "key", succeeded="ok"),
        "admit": lambda s: state.admit_stream(s, ["key"]),
        "debounce": lambda s: state.debounce_stream(s, "key"),
        "votes": lambda s: state.first_votes_stream(s),
    }
    for name, flow in flows_.items():
        where = tmp_path / name
        got = run(spark, root, flow, where, ["arrival_seq"])
        assert len(got) >= 53
        kept = (
            spark.read.format("statestore").option("path", str(where / "cp")).option("stateVarName", "state").load()
        )
        names = {r[0] for r in kept.select(F.col("key").cast("string")).collect()}
        assert len(names) == 3 and all("late" in n for n in names), (name, names)


def test_ttl_stream(spark, messages, tmp_path):
    got = run(spark, messages, lambda s: state.ttl_dedup_stream(s, "key", succeeded="ok"), tmp_path,
              ["arrival_seq", "accepted"])
    want = rows_of(ttl_dedup(spark.read.parquet(messages), "key", "t_us", "arrival_seq", succeeded="ok"),
                   ["arrival_seq", "accepted"])
    assert got == want


def test_admission_stream(spark, messages, tmp_path):
    kw = dict(limit=3, window_us=600_000_000)
    got = run(spark, messages, lambda s: state.admit_stream(s, ["key"], **kw), tmp_path,
              ["arrival_seq", "allowed", "retry_after"])
    want = rows_of(admit(spark.read.parquet(messages), ["key"], "t_us", "arrival_seq", **kw),
                   ["arrival_seq", "allowed", "retry_after"])
    assert got == want


def test_debounce_and_first_votes_stream(spark, messages, tmp_path):
    got = run(spark, messages, lambda s: state.debounce_stream(s, "key"), tmp_path / "a", ["arrival_seq"])
    want = rows_of(debounce(spark.read.parquet(messages), "key", "content", "arrival_seq"), ["arrival_seq"])
    assert got == want
    votes = spark.read.parquet(messages).withColumn("scan_id", F.col("key"))
    got = run(spark, messages,
              lambda s: state.first_votes_stream(s.withColumn("scan_id", F.col("key"))),
              tmp_path / "b", ["arrival_seq", "inserted"])
    none = votes.where("false").select("scan_id")
    want = rows_of(mark_inserted(votes, none), ["arrival_seq", "inserted"])
    assert got == want


def test_link_watch(spark, tmp_path):
    root = str(tmp_path / "screens")
    day = 1_000_000
    data = [
        ("d1", 1, 0, "go http://192.168.1.1@secure-login-verify.xyz/account now"),
        ("d1", 2, 5 * day, "go http://192.168.1.1@secure-login-verify.xyz/account again"),
        ("d1", 3, 700 * day, "go http://192.168.1.1@secure-login-verify.xyz/account later"),
        ("d1", 4, 701 * day, "Security alert: unusual activity on your profile today"),
        ("d1", 5, 702 * day, "nothing here"),
        ("d2", 6, 0, "http://192.168.1.1@secure-login-verify.xyz/account and example.com/ok"),
    ]
    spark.createDataFrame(data, "device_id string, arrival_seq long, t_us long, text string").coalesce(
        1).write.parquet(root)
    cols = ["device_id", "t_us", "url", "classification"]
    got = run(spark, root, lambda s: flows.link_watch(s).select(*cols), tmp_path, cols)
    bad = "http://192.168.1.1@secure-login-verify.xyz/account"
    assert got == sorted([
        ("d1", 0, bad, "Phishing"), ("d1", 700 * day, bad, "Phishing"),
        ("d1", 701 * day, None, "Suspicious"),
        ("d2", 0, bad, "Phishing"), ("d2", 0, "https://example.com/ok", "Safe"),
    ], key=str)


SCREEN_DDL = "device_id string, arrival_seq long, t_us long, text string"


def test_link_watch_takes_marks_of_failed_scans_back(spark, tmp_path):
    """Two runs; the first one's failed scan is reported to the second one, which takes the link again."""
    root, screens, sec = str(tmp_path / "out"), str(tmp_path / "screens"), 1_000_000
    lost, bad = "http://example.com:99999/x", "http://192.168.1.1@secure-login-verify.xyz/account"
    parts = [
        [("d1", 1, 0, f"see {lost}"), ("d1", 2, sec, f"go {bad}"), ("d2", 3, 2 * sec, f"{lost} and {bad}")],
        [("d1", 4, 60 * sec, f"again {lost}"), ("d1", 5, 61 * sec, f"again {bad}"), ("d2", 6, 62 * sec, f"and {lost}")],
    ]
    tables = feeds.seed_indicators(spark, "2024-01-01")

    def once():
        failed = flows.failed_scans(spark, root)
        stream = spark.readStream.schema(SCREEN_DDL).parquet(screens)
        query = (
            flows.link_watch(stream, failed).writeStream.foreachBatch(flows.link_watch_batch(tables, root, sec))
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination(240)
        assert query.exception() is None

    for part in parts:
        spark.createDataFrame(part, SCREEN_DDL).coalesce(1).write.mode("append").parquet(screens)
        once()
    failed = spark.read.schema(flows.FAILED).option("recursiveFileLookup", True).parquet(root + "/failed")
    assert rows_of(failed, ["device_id", "arrival_seq", "position", "watch_key"]) == [
        ("d1", 1, 0, lost), ("d1", 4, 0, lost), ("d2", 3, 0, lost), ("d2", 6, 0, lost)]
    history = spark.read.schema(flows.HISTORY).parquet(root + "/history")
    assert rows_of(history, ["timestamp_millis", "source_type"]) == [
        (1000, "accessibility_guard"), (2000, "accessibility_guard")]
    alerts = spark.read.parquet(root + "/alerts")
    assert alerts.count() == 2 and alerts.where("classification = 'Safe'").isEmpty()
    assert spark.read.parquet(root + "/instant").where(F.col("watch_key") == bad).count() == 2
    # the table form over the same screens and reports decides alike
    rows = flows.link_watch_rows(spark.read.parquet(screens), failed)
    taken = rows_of(rows.where("accepted"), ["device_id", "arrival_seq", "watch_key"])
    assert taken == [("d1", 1, lost), ("d1", 2, bad), ("d1", 4, lost), ("d2", 3, bad), ("d2", 3, lost), ("d2", 6, lost)]


def test_watch_batch_written_again_is_the_same(spark, tmp_path):
    root = str(tmp_path)
    screens = spark.createDataFrame([("d1", 1, 0, "go http://192.168.1.1@secure-login-verify.xyz/account")], SCREEN_DDL)
    targets = flows.triage(flows.link_watch_rows(screens).where("accepted"))
    write = flows.link_watch_batch(feeds.seed_indicators(spark, "2024-01-01"), root)
    for _ in range(2):
        write(targets, 0)
    for name in ("instant", "alerts", "history"):
        assert spark.read.parquet(f"{root}/{name}").count() == 1


def test_watch_gate_cases(spark):
    minute = 60_000_000
    ddl = "device_id string, arrival_seq long, position int, t_us long, watch_key string, failed boolean, accepted_before string"
    data = [
        ("a", 1, 0, 0, "k", False, "x"), ("a", 2, 0, minute, "k", False, "x"),  # marked
        ("a", 1, 0, minute + 1, "k", True, "x"), ("a", 3, 0, 2 * minute, " k ", False, "x"),  # taken back
        ("a", 1, 0, 2 * minute + 1, "k", True, "x"), ("a", 4, 0, 3 * minute, "k", False, "x"),  # report of an older mark
        ("a", 5, 0, 13 * minute, "k", False, "x"), ("a", 6, 0, 13 * minute, "  ", False, "x"),
        ("a", 7, 0, 14 * minute, None, False, None), (None, 8, 0, 0, "k", False, "x"),
        ("b", 9, 0, 0, "k", None, "x"), ("b", 9, 0, 0, "k", None, "x"), ("c", 10, 0, None, "k", False, "x"),
    ]
    out = watch_gate(spark.createDataFrame(data, ddl))
    assert rows_of(out.where("accepted"), ["arrival_seq"]) == [(1,), (3,), (5,), (9,)]
    assert out.count() == len(data)
    assert watch_gate(spark.createDataFrame([], ddl)).count() == 0
