"""Feeds, votes, history, mail, shares and verdict documents."""

import base64
import json

from pyspark.sql import functions as F

from riskflow.plans import metrics
from riskflow.sources import feedback as fb, feeds, history as hi, mail, scans, share, verdicts
from riskflow.streaming import flows

ID = "00000000-0000-4000-8000-{:012d}"


def test_feeds(spark, tmp_path):
    (tmp_path / "uh.csv").write_text(
        '# head\r\n"1","2024","http://bad.x/a","online","l","malware_download","tag,one","u","r"\r\n\r\n"2","2024","short"\n'
        '"3","2024","http://both.x/p","offline","l","malware_download","","u","r"\n')
    sha = "AB" * 32
    (tmp_path / "mb.csv").write_text(
        f'"2024-01-01","{sha}","m","s","r","f","exe","mime","n/a","","x"\n"2024-01-02","{"cd" * 32}","m","s","r","f","dll","mime","","Clam.X","77.5"\n"too","short"\n')
    (tmp_path / "op.txt").write_text("http://both.x/p\nnot a link\n  https://phish.x/login  \n")
    stored = feeds.seed_indicators(spark, "2024-01-01")
    new, summary, meta = feeds.refresh(spark, stored, "2024-02-01", str(tmp_path / "uh.csv"),
                                       str(tmp_path / "mb.csv"), str(tmp_path / "op.txt"))
    urls = {r.url: r for r in new.urls.collect()}
    assert set(urls) == {"http://bad.x/a", "http://both.x/p", "https://phish.x/login"}
    assert urls["http://both.x/p"].source == "OpenPhish" and urls["http://bad.x/a"].tags == "tag,one"
    assert urls["http://bad.x/a"].domain == "bad.x" and urls["http://bad.x/a"].first_seen == "2024-02-01"
    h = {r.sha256: r for r in new.hashes.collect()}
    assert h[sha.lower()].vt_percent == 100.0 and h[sha.lower()].clamav == "Detected" and len(h) == 11
    assert h["cd" * 32].signature == "MalwareSample" and h["cd" * 32].vt_percent == 77.5
    s = summary.first()
    assert (s.status, s.urlhaus_urls_added, s.malwarebazaar_hashes_added, s.openphish_urls_added) == ("success", 2, 2, 2)
    stats = feeds.statistics(new, meta).first()
    assert (stats.threat_urls_count, stats.malware_hashes_count, stats.last_synced) == (3, 11, "2024-02-01")
    _, summary, _ = feeds.refresh(spark, stored, "2024-02-01", urlhaus=str(tmp_path / "missing"))
    assert summary.first().status == "partial" and feeds.statistics(stored).first().status == "ready"
    snap = flows.refresh_snapshot(spark, stored, "2024-02-01", str(tmp_path / "snap"), openphish=str(tmp_path / "op.txt"))
    assert snap.urls.count() == 2


def test_feedback(spark):
    rows = [(1, ID.format(1), "correct", "Safe", 10.0, 0.9, "url"), (2, ID.format(1), "incorrect", "Safe", 10.0, 0.9, "url"),
            (3, ID.format(2), "negative", "Phishing", 50.0, 0.9, None), (4, ID.format(3), "positive", "Phishing", 90.0, 0.9, "gmail"),
            (5, ID.format(4), "negative", "Malware", 75.0, 0.9, "file"), (6, "bad id", "positive", "Safe", 1.0, 0.5, "url"),
            (7, ID.format(6), "positive", "Safe", float("nan"), 0.5, "url"), (8, ID.format(7), "positive", "Odd", 1.0, 0.5, "url")]
    votes = fb.adapt_legacy(spark.createDataFrame(rows, "arrival_seq long, " + fb.FEEDBACK))
    good, bad = fb.validate(votes)
    assert {r.arrival_seq: r.reason for r in bad.collect()} == {
        6: "scan_id", 7: "risk_score_at_scan_time", 8: "classification_at_scan_time"}
    stored = spark.createDataFrame([], fb.FEEDBACK)
    kept = fb.accept(good, stored, "2024-01-01 00:00:00")
    assert kept.count() == 4 and kept.where("arrival_seq = 1").first().feedback_value == "up"
    assert kept.first().timestamp == "2024-01-01T00:00:00Z"
    m = metrics.evaluation_metrics(kept).first()
    assert (m.total_feedback_count, m.positive_feedback_rate) == (4, 0.5)
    assert (m.average_risk_score_positive, m.average_risk_score_negative) == (50.0, 62.5)
    assert m.feedback_count_by_classification == {"Safe": 1, "Suspicious": 0, "Deceptive": 0, "Phishing": 2, "Malware": 1}
    assert m.feedback_count_by_source_type["unknown"] == 1 and m.feedback_count_by_source_type["share"] == 0
    empty = metrics.evaluation_metrics(stored.withColumn("arrival_seq", F.lit(0))).first()
    assert empty.total_feedback_count == 0 and empty.positive_feedback_rate == 0.0 and empty.average_risk_score_positive is None
    old = spark.createDataFrame([(ID.format(9), "up", "Safe", 5.0)], "analyzed_target string, feedback_value string, category string, score double")
    r = fb.adapt_legacy(old).first()
    assert (r.scan_id, r.user_feedback, r.classification_at_scan_time, r.source_type) == (ID.format(9), "positive", "Safe", "unknown")
    back = fb.backfill(spark.createDataFrame([("x",)], "scan_id string"), fb.FEEDBACK, {"source_type": "unknown"}).first()
    assert back.source_type == "unknown" and back.user_feedback is None


def test_history(spark):
    rows = [("local-" + ID.format(1), "Safe", 10.0, 0.5, ["call a@b.c.org"], ["bad flag!"], "go"),
            (ID.format(2), "Phishing", 90.0, 0.5, [""], [], "go"), ("nope", "Safe", 1.0, 0.5, [], [], "go"),
            (ID.format(3), "Odd", 1.0, 0.5, [], [], "go"), (ID.format(4), "Safe", 101.0, 0.5, [], [], "go")]
    v = spark.createDataFrame(rows, "scan_id string, classification string, risk_score double, confidence double,"
                                    " reasons array<string>, flags array<string>, recommended_action string")
    v = v.withColumn("evidence", F.expr("array(named_struct('key','k y','value','v','description','d'))"))
    rec = hi.history_records(v, F.lit("GMAIL"), F.lit(5))
    got = {r.scan_id: r for r in rec.collect()}
    assert set(got) == {"local-" + ID.format(1), ID.format(2)}
    one = got["local-" + ID.format(1)]
    assert (one.reasons, one.flags, one.evidence_keys, one.source_type) == (["call [address]"], ["bad_flag_"], ["k_y"], "gmail")
    assert got[ID.format(2)].reasons == []
    stored = rec.where("classification = 'Safe'")
    assert [r.scan_id for r in hi.new_records(rec, stored).collect()] == [ID.format(2)]
    assert hi.history_page(rec, limit=0, classification="nonsense").count() == 1
    upd = spark.createDataFrame([(ID.format(2), "positive"), ("local-" + ID.format(1), "maybe")], "scan_id string, feedback_state string")
    assert {r.scan_id: r.feedback_state for r in hi.update_feedback(rec, upd).collect()} == {
        ID.format(2): "positive", "local-" + ID.format(1): None}
    assert hi.delete_scans(rec, stored).count() == 1 and hi.delete_all(rec).count() == 0
    assert metrics.history_stats(rec).first() == (2, 1)


def b64(text, charset="utf-8"):
    return base64.urlsafe_b64encode(text.encode(charset)).decode().rstrip("=")


def test_mail_and_inbox(spark, tmp_path):
    part = lambda mime, data, name="", att=None, ct=None: (mime, name, att, {"Content-Type": ct} if ct else {}, data)
    rows = [
        ("m1", {"from": "A <a@b.c>", "Subject": "S"}, [part("text/html", b64("<p>html</p>")), part("text/plain", b64("see http://x.y/z."))]),
        ("m2", {"From": "a@b.c"}, [part("text/html; q=1", b64("<a href='http://q.r/s'>go</a> café", "latin-1"), ct="text/html; charset=iso-8859-1")]),
        ("m3", {}, [part("text/plain", b64("x"), name="f.txt"), part("text/plain", b64("y"), att="id")]),
        ("", {}, [part("text/plain", b64("x"))]), ("m5", {}, None),
        ("m6", {"From": "b@evil.xyz"}, [part("text/plain", b64("URGENT! account locked, verify your password, send a gift card, you are a winner"))]),
    ]
    df = spark.createDataFrame(rows, "message_id string, headers map<string,string>, parts array<struct<mime:string,"
                               "filename:string,attachment_id:string,headers:map<string,string>,data:string>>")
    out = mail.extract_mail(df)
    r = {x.message_id: x for x in out.collect()}
    assert (r["m1"].body_text, r["m1"].subject) == ("see http://x.y/z.", "S") and r["m1"].urls == ["http://x.y/z"]
    assert r["m2"].body_text == "go http://q.r/s café" and r["m2"].urls == ["http://q.r/s"]
    assert [r[k].status for k in ("m3", "", "m5")] == ["missing_body", "malformed", "malformed"]
    s = {x.scan_id: x for x in mail.mail_to_scans(out).collect()}
    assert s["m1"].text == "Subject: S\nFrom: A <a@b.c>\n\nsee http://x.y/z." and s["m1"].source_channel == "gmail"
    assert tuple(mail.fetch_summary(out).first()) == (3, 3, "messages")
    body = flows.inbox_batch(feeds.seed_indicators(spark, "2024-01-01"), str(tmp_path),
                             F.concat(F.lit("00000000-0000-4000-8000-0000000000"), F.lpad(F.regexp_extract("scan_id", "(\\d+)", 1), 2, "0")))
    stamped = out.withColumns({"ts": F.lit("2024-01-01").cast("timestamp"), "arrival_seq": F.monotonically_increasing_id()})
    for batch in (0, 1, 1):  # a repeated batch must not double anything
        body(stamped if batch else stamped.where("message_id = 'm1'"), batch)
    assert spark.read.parquet(str(tmp_path / "history")).count() == 3
    assert spark.read.parquet(str(tmp_path / "processed")).count() == 3
    alerts = spark.read.parquet(str(tmp_path / "alerts")).collect()
    assert [a.scan_id[-2:] for a in alerts] == ["06"]


def test_shares(spark):
    send = share.SEND
    rows = [("a", "x", None, "t", None, None, None, None, None), ("b", send, "text/plain", " go http://a.b/c. ", None, None, None, None, None),
            ("c", send, "text/plain", "http://a.b/c", None, None, None, None, None), ("d", send, "image/png", "t", None, None, None, None, None),
            ("e", send, "text/csv", None, "content://f", None, "f.csv", "1,2", None), ("f", send, "text/csv", None, "content://f", None, "f.csv", "", None),
            ("g", send, None, None, None, "http://d.e/", None, None, None), ("h", send, None, " ", None, None, None, None, None),
            ("i", send, "image/png", None, "content://f", None, "f", "x", None), ("j", send, "text/x", "hello", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, action string, mime_type string, text string, stream_uri string, data_uri string,"
                                     " file_name string, file_content string, file_error string")
    r = {x.id: (x.kind, x.scan_url, x.scan_text, x.reject_reason) for x in share.route_shares(df).collect()}
    assert r["a"][3] == "Unsupported share action." and r["d"][3] == "Unsupported shared content type."
    assert r["b"] == ("URL", "http://a.b/c", "go http://a.b/c.", None) and r["c"] == ("URL", "http://a.b/c", None, None)
    assert r["e"][0] == "File" and r["f"][3] == "Shared file is empty." and r["g"] == ("URL", "http://d.e/", None, None)
    assert r["h"][3] == "No shared text or URL was provided." and r["i"][3] == "Unsupported shared file type." and r["j"][0] == "Text"


def test_verdict_contract(spark):
    good = {"scan_id": "s", "status": "completed", "total_engines": 7, "completed_engines": 1, "skipped_engines": 6, "risk_score": 1.5,
            "classification": "Safe", "risk_assessment": {"risk_score": 1, "classification": "Safe", "confidence": 0.5,
            "contributing_engines": ["a"], "ignored_engines": [], "flags": [], "evidence": [{"key": "k", "value": {"a": 1}, "description": "d"}],
            "reasons": ["r"], "recommended_action": "x"}, "results": [{"engine_name": "a", "risk_score": 1, "confidence": 1, "flags": [],
            "evidence": [], "status": "success", "error_message": None, "metadata": {}}], "warnings": None}
    change = lambda **kw: json.dumps({**good, **kw})
    docs = [("ok", json.dumps(good)), ("num", change(scan_id=5)), ("list", change(warnings=[1])), ("results", change(results=[{"engine_name": "a"}])),
            ("text", "not json"), ("missing", json.dumps({k: v for k, v in good.items() if k != "risk_score"})),
            ("ev", change(risk_assessment={**good["risk_assessment"], "evidence": [{"key": "k", "description": "d"}]}))]
    ok, bad = verdicts.check_verdicts(spark.createDataFrame(docs, "id string, body string"))
    assert [(r.id, r.verdict.risk_score) for r in ok.collect()] == [("ok", 1.5)]
    assert {r.id for r in bad.collect()} == {"num", "list", "results", "text", "missing", "ev"}


def test_scan_requests(spark, tmp_path):
    f = tmp_path / "in.jsonl"
    f.write_text('{"scan_id":"1","text":"hi","file_bytes":"aGk="}\n{"scan_id":"2","image_bytes":"a!"}\n{"scan_id": "3", "text": [1}\n')
    good, bad = scans.decode_scans(scans.read_scan_requests(spark, str(f)))
    assert [(r.scan_id, bytes(r.file_bytes)) for r in good.collect()] == [("1", b"hi")]
    assert sorted(r.reject_reason for r in bad.collect()) == ["image_bytes must be base64-encoded when sent as a string.", "unreadable request"]


def test_inbox_knows_senders_of_earlier_batches(spark, tmp_path):
    """Batches fold their messages into the stored profiles; a repeated batch starts from the one before."""
    from riskflow.plans.scan import scan
    from riskflow.sources.scans import decode_scans  # noqa: F401

    def mails(ids):
        day = lambda i: f"2024-01-01 {8 + i % 3:02d}:{i % 60:02d}:00"
        rows = [(f"m{i}", f"Ann <ann@{'x' if i < 9 else 'evil'}.org>", f"hello number {i}", day(i)) for i in ids]
        return spark.createDataFrame(rows, "scan_id string, sender_id string, text string, time string").selectExpr(
            "scan_id", "sender_id", "text", "cast(time AS timestamp) AS ts", "cast(substr(scan_id, 2) AS bigint) AS arrival_seq")

    from riskflow.plans.scan import senders_after

    tables = feeds.seed_indicators(spark, "2024-01-01")
    whole = {r.scan_id: (list(r.flags), r.risk_score) for r in scan(mails(range(12)), tables)[0].collect()}
    root, got = str(tmp_path), {}
    for batch, ids in enumerate((range(5), range(5, 9), range(9, 12))):
        for _ in range(2 if batch == 1 else 1):  # a batch that is run again
            known = flows.stored_senders(spark, root, batch)
            got.update({r.scan_id: (list(r.flags), r.risk_score) for r in scan(mails(ids), tables, senders=known)[0].collect()})
            flows.store_senders(senders_after(mails(ids), known), root, batch)
    assert got == whole
    assert sum("new_sender" in f for f, _ in got.values()) == 2
    last = flows.stored_senders(spark, root)
    assert {r.profile_key: r.message_count for r in last.profiles.collect()} == {"ann@x.org": 9, "ann@evil.org": 3}
    assert [r.last_domain for r in last.names.collect()] == ["x.org"]


PARTS = "message_id string, headers map<string,string>, parts array<struct<mime:string,filename:string,attachment_id:string,headers:map<string,string>,data:string>>"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_mail_bodies_are_decoded_once_per_part(spark):
    white = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    body = lambda data, ct="text/plain": ("text/plain", "", None, {"content-type": ct}, data)
    wrapped = "\r\n".join(b64("a" * 60 + "?>~ ÿ").replace("_", "/").replace("-", "+")[i:i + 7] for i in range(0, 99, 7))
    rows = [("m1", {}, [body(b64(white + "x" + white + "y" + white))]), ("m2", {}, [body(wrapped), body(""), body(None), body("A"), body(b64("é", "utf-16le"), "t; charset=UTF-16LE")]),
            ("m3", {}, [body(b64("HTTP://a.b/c) no://link http://a.b/c"))]), ("m4", {}, [body(b64("\u200bz\x1c"))])]
    out = mail.extract_mail(spark.createDataFrame(rows, PARTS))
    got = {r.message_id: r for r in out.collect()}
    assert got["m1"].body_text == "x" + white + "y" and got["m4"].body_text == "\u200bz\x1c"
    assert got["m2"].body_text == "a" * 60 + "?>~ ÿ\né"
    assert got["m3"].urls == ["HTTP://a.b/c", "http://a.b/c"] and got["m1"].urls == []
    # one decoding step for plain and one for HTML parts
    assert optimized(out).count("unbase64(") == 2


def test_mail_scans_test_the_status_without_decoding_again(spark):
    out = mail.extract_mail(spark.createDataFrame([("m1", {}, [("text/plain", "", None, {}, b64("x"))]), ("m2", {}, None)], PARTS))
    found = mail.mail_to_scans(out)
    assert [r.scan_id for r in found.collect()] == ["m1"]
    assert optimized(found).count("unbase64(") == optimized(out).count("unbase64(")
