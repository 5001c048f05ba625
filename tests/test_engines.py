"""Golden rows per engine."""

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from riskflow import dims
from riskflow.functions import text as tx
from riskflow.functions import urls as ur
from riskflow.functions.columns import engine_result, error_result, skipped_result
from riskflow.operators import (
    attachment_rules as ar, explain as ex, file_signals as fs, fusion as fu, header_signals as hs,
    indicators as ind, redirects as rd, sender_rules as sr, text_signals as ts, triage as tr,
    url_signals as us, visual_rules as vr,
)
from riskflow.plans.scan import EngineRegistry, default_registry, python_engine, scan
from riskflow.sources import feeds, scans


def one_column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


# ------------------------------------------------------------------ normalization
def test_text_normalization(spark):
    got = one_column(spark, [
        "  Line   one with   spaces.  \t\n\n\n\n\nLine   two.\r\nLine   three.  ",
        "Ｐａｓｓｗｏｒｄ ﬁne", "a\x00b\x7fc", "", " \n ", "x" * 50_500,
    ], lambda c: tx.normalize_text(c, max_chars=50_000))
    assert got[0]["text"] == "Line one with spaces.\n\nLine two.\nLine three."
    assert got[1]["text"] == "Password fine"
    assert (got[2]["text"], got[2]["warnings"]) == ("abc", ["control_characters_stripped"])
    assert got[3]["text"] is None and got[4]["text"] is None
    assert len(got[5]["text"]) == 50_000 and got[5]["warnings"] == ["text_truncated_to_max_length"]


def test_url_normalization(spark):
    cases = {
        "HTTPS://ExAmPlE.Com:443/Path/To/Page?key=Val#Sec": ("https://example.com/Path/To/Page?key=Val#Sec", []),
        "<http://example.com/test>": ("http://example.com/test", []),
        "example.com": ("http://example.com", ["url_scheme_defaulted_to_http"]),
        "javascript:alert(1)": (None, ["unsupported_scheme_javascript"]),
        "http://": (None, ["missing_url_host"]),
        "http://user:pw@H.example.com:8080/x": ("http://user:pw@h.example.com:8080/x", ["url_embedded_credentials_present"]),
        "http://host_x.example.com/?": ("http://host_x.example.com/", []),
        '"': (None, ["empty_url_after_stripping"]),
        "http://e.com/\x01": (None, ["url_contains_control_characters"]),
        "http://e.com:abc/": (None, ["preprocessing_error: Port could not be cast to integer value as 'abc'"]),
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    rows = ur.normalize_url(df, "u", "n").collect()
    assert {r.u: (r.n, r.n_warnings) for r in rows} == cases


def test_extraction_redaction_html(spark):
    assert one_column(spark, [
        "Your OTP: 123456, password reset", "mail a.b@c.org or +1 (555) 123-4567 via www.x.y/z",
        "token is abc; id abcdefghijklmnopqrstuvwxyz0123456789AB pin 4321 code 98765",
    ], tx.redact) == [
        "Your OTP: [redacted], password reset", "mail [address] or [number] via [link]",
        "token: [redacted]; id [redacted] pin: [redacted] code [number]",
    ]
    html = ("<style>x</style><p>Hi &amp;lt; &#x1F600;&#65;</p><a class=b href='http://x.y/z'>go</a><br/>"
            "<script>bad()</script>&nbsp;end")
    assert one_column(spark, [html], tx.html_to_text) == ["Hi &lt; \U0001F600A\ngo http://x.y/z\nend"]
    assert one_column(spark, ["(see example.com/a), WWW.foo.bar! http://q.z. example.com/a"], ur.extract_screen_urls) == [
        ["https://example.com/a", "https://WWW.foo.bar", "http://q.z"]]
    assert one_column(spark, ["8.8.8.8", "10.1.1.1", "172.32.0.1", "::1", "2606:4700::1", "::ffff:8.8.8.8", "x",
                              "2001:db8::1", "100.64.0.1", "fe80::1"], ur.is_public_address) == [
        True, False, True, False, True, False, False, False, False, False]


# ------------------------------------------------------------------ link and text engines
def test_url_flags(spark):
    df = spark.createDataFrame([
        ("http://192.168.1.1@secure-login-verify.xyz/login",), ("https://www.google.com",),
        ("https://a-b-c-d.example.top:8080//x?q=1&b=2&c=%20_",), ("https://reddit.com/r",),
        ("https://e.com/?d=QWxhZGRpbjpvcGVuIHNlc2FtZTEyMzQ1Njc4OTA=",), ("http://x.xyz:8080/",),
    ], "url string")
    rows = {r.url: r for r in us.with_url_signals(df).collect()}
    first = rows["http://192.168.1.1@secure-login-verify.xyz/login"]
    assert first.lex_score == pytest.approx(0.9)
    assert first.lex_flags[:3] == ["ip_based_host", "at_symbol_present", "suspicious_tld"]
    assert rows["https://www.google.com"].lex_flags == []
    third = rows["https://a-b-c-d.example.top:8080//x?q=1&b=2&c=%20_"].lex_flags
    assert "high_hyphen_count(3)" in third and "non_standard_port" in third
    assert "double_slash_redirect" in third and "special_char_overload" in third
    assert "suspicious_tld" not in third and "suspicious_tld" not in rows["http://x.xyz:8080/"].lex_flags
    assert "url_shortener" in rows["https://reddit.com/r"].lex_flags
    assert "base64_obfuscation" in rows["https://e.com/?d=QWxhZGRpbjpvcGVuIHNlc2FtZTEyMzQ1Njc4OTA="].lex_flags


def test_text_rules(spark):
    df = spark.createDataFrame([
        (1, "act now! You are a winner! Send your password to claim bitcoin."),
        (2, "Your SBI OTP is 483920. Do not share it with anyone."), (3, "Your account was suspended"),
        (4, "Please do not share; never share your otp"), (5, "lunch at 12?"),
    ], "i int, text string")
    rows = {r.i: r for r in ts.with_text_signals(df).collect()}
    assert rows[1].text_score == 100.0 and len(rows[1].text_evidence) == 4
    assert rows[2].text_flags == [] and rows[4].text_flags == [] and rows[5].text_score == 0.0
    assert rows[3].text_score == pytest.approx(35.0) and rows[3].text_flags == ["nlp_account_suspension"]


def test_headers(spark):
    base = {"From": "Bob <bob@corp.com>", "Message-ID": "<1@corp.com>"}
    cases = [
        (base, None, None, None), ({**base, "Reply-To": "x@evil.com"}, None, None, None),
        ({**base, "Reply-To": "al@corp.com"}, None, None, None),
        ({**base, "spf": "softfail", "Authentication-Results": "spf=fail dkim=fail"}, None, None, None),
        ({**base, "Date": "Mon, 20 Nov 1995 19:12:08 -0500"}, 1700000000.0, None, None),
        ({**base, "Date": "20 Nov 1995 19:12:08 GMT"}, 816894728.0, None, None),
        (base, None, ["ok", "Suspicious hop"], None), (None, None, None, "bob@corp.com"),
        ({"From": "a@b.c", "Reply-To": "x@y.z", "Return-Path": "<q@y.z>", "spf": "fail", "Received": "FORGED"}, None, None, None),
    ]
    df = spark.createDataFrame(
        [(i, h, m, r, s, None) for i, (h, m, r, s) in enumerate(cases)],
        "i int, headers map<string,string>, meta_ts double, received array<string>, sender_id string,"
        " metadata map<string,string>")
    rows = hs.with_header_signals(hs.with_headers(df)).withColumn("r", hs.header_result()).orderBy("i").collect()
    flags = [r.r.flags for r in rows]
    assert flags[0] == [] and rows[0].r.confidence == 1.0
    assert (flags[1], rows[1].header_score) == (["REPLY_TO_MISMATCH"], pytest.approx(30.0))
    assert rows[2].header_score == pytest.approx(10.0)
    assert flags[3] == ["SPF_FAILURE", "DKIM_FAILURE", "AUTHENTICATION_FAILURE"]
    assert flags[4] == ["TIMESTAMP_ANOMALY"] and flags[5] == [] and flags[6] == ["RECEIVED_CHAIN_ANOMALY"]
    assert rows[7].r.status == "skipped" and rows[8].header_score == pytest.approx(90.0)


# ------------------------------------------------------------------ senders
def test_senders(spark):
    t0, day, out = 1_700_000_000, 86_400, []
    add = lambda c, s, t, dom=None, link=False, file=False: out.append(
        (c, s, dom, int(t * 1_000_000), len(out) + 1, link, file))
    add("a", "alice@test.com", t0), add("a", "alice@test.com", t0 + 10)                       # 1, 2
    for d in range(6):
        add("a", "bob@test.com", t0 + d * day)                                                # 3..8
    add("a", "bob@test.com", t0 + 6 * day + 5 * 3600)                                         # 9
    for d in range(6):
        add("a", "spam@test.com", t0 + d * day)                                               # 10..15
    for s in range(11):
        add("a", "spam@test.com", t0 + 6 * day + s)                                           # 16..26
    add("a", "internal", t0, "old.com"), add("a", "internal", t0 + 100, "new.com")            # 27, 28
    add("b", '"IT Support" <help@corp.com>', t0), add("c", '"IT Support" <x@phish.com>', t0 + 3600)  # 29, 30
    add("b", '"IT Support" <x@phish.com>', t0 + 3600), add("b", '"IT Support" <help@corp.com>', t0 + 9000)  # 31, 32
    for d in range(4):
        add("d", "q@q.q", t0 + d * day)                                                       # 33..36
    add("d", "q@q.q", t0 + 4 * day, link=True, file=True)                                     # 37
    add("", "late@x.y", t0), add(None, "late@x.y", t0 - 500)                                  # 38, 39
    df = spark.createDataFrame(out, "client_id string, sender_raw string, sender_domain string, t_us long,"
                                    " arrival_seq long, has_link boolean, has_file boolean")
    for chunk, slice_us in ((5_000_000, sr.SLICE_US), (3, 1_800_000_000)):
        rows = {r.arrival_seq: r for r in sr.with_sender_signals(
            sr.with_sender_history(df, chunk, slice_us)).collect()}
        f = lambda i: rows[i].sender_flags
        assert (f(1), rows[1].sender_score, rows[1].sender_confidence) == (["new_sender"], 20.0, 0.5)
        assert f(2) == ["rapid_sender_activity"] and rows[2].sender_confidence == 0.8
        assert f(9) == ["unusual_time"]
        assert "unusual_frequency" not in f(25) and "unusual_frequency" in f(26)
        assert f(28) == ["sender_change"] and f(30) == ["new_sender"]
        assert f(31) == ["new_sender", "sender_change"] and f(32) == []
        assert f(37) == ["out_of_character_link", "out_of_character_file"]
        assert f(39) == ["rapid_sender_activity"] and rows[39].client_id == "anonymous"


# ------------------------------------------------------------------ attachments
def zipped(entries, encrypted=False):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for n, d in entries:
            z.writestr(n, d)
    return buf.getvalue()


def tarred(entries):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w") as t:
        for n, d in entries:
            info = tarfile.TarInfo(n)
            info.size = len(d)
            t.addfile(info, io.BytesIO(d))
    return buf.getvalue()


def test_attachments(spark):
    pe = b"MZ\x90\x00" + b"\x00" * 60
    S = "SUSPICIOUS_ARCHIVE"
    cases = {
        "report.pdf": (b"%PDF-1.4 hello", []),
        "photo.jpg": (pe, ["ATTACHMENT_TYPE_MISMATCH", "EXECUTABLE_ATTACHMENT"]),
        "bill.pdf.exe": (pe, ["DOUBLE_EXTENSION", "EXECUTABLE_ATTACHMENT"]),
        "deploy.ps1": (b"Write-Host 1", ["SCRIPT_ATTACHMENT", "SUSPICIOUS_EXTENSION"]),
        "model.docm": (zipped([("[Content_Types].xml", "x"), ("word/vbaProject.bin", "x")]), ["MACRO_PRESENT"]),
        "deck.pptx": (zipped([("[Content_Types].xml", "x"), ("ppt/vbaProject.bin", "x")]), ["MACRO_PRESENT"]),
        "form.pdf": (b"%PDF-1.5 /JS (app.alert)", ["EMBEDDED_SCRIPT"]),
        "note.rtf": (b"{\\rtf1 \\objdata 01}", ["EMBEDDED_SCRIPT"]),
        "old.doc": (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"_VBA_PROJECT", ["MACRO_PRESENT"]),
        "clean.zip": (zipped([("a.txt", "x"), ("b.txt", "y")]), []),
        "nested.zip": (zipped([("in.zip", zipped([("a.txt", "x")])), ("b.txt", "y")]), ["NESTED_ARCHIVE"]),
        "deep.zip": (zipped([("in.zip", zipped([("x.zip", "x"), ("y.exe", "x")])), ("b.txt", "y")]),
                     ["ARCHIVE_DEPTH_ANOMALY", "NESTED_ARCHIVE"]),
        "inner.zip": (zipped([("in.zip", zipped([("y.exe", "x")])), ("b.txt", "y")]),
                      ["EXECUTABLE_ATTACHMENT", "NESTED_ARCHIVE", S]),
        "up.zip": (zipped([("../../etc/passwd", "x"), ("b.txt", "y")]), [S]),
        "long.zip": (zipped([("a/b/c/d/e/f.txt", "x"), ("b.txt", "y")]), ["ARCHIVE_DEPTH_ANOMALY"]),
        # any zip whose directory names a program also counts as holding an embedded object
        "drop.zip": (zipped([("update.exe", "x")]), ["EMBEDDED_SCRIPT", "EXECUTABLE_ATTACHMENT", S]),
        "bomb.zip": (zipped([("z.txt", b"0" * 2_000_000), ("b.txt", "y")]), ["ARCHIVE_EXPANSION_ANOMALY"]),
        "bad.zip": (b"PK\x03\x04garbage", [S]),
        "clean.tar": (tarred([("a.txt", b"x"), ("b.txt", b"y")]), []),
        "load.tar": (tarred([("run.sh", b"x"), ("b.txt", b"y")]), ["SCRIPT_ATTACHMENT", S]),
        "abs.tar": (tarred([("/etc/x", b"x"), ("b.txt", b"y")]), [S]),
        "many.tar": (tarred([(f"f{i}.txt", b"") for i in range(205)]), [S]),
        "plain.gz": (b"\x1f\x8b\x08nonsense", [S]),
        "rtlo‮fdp.exe": (pe, ["DOUBLE_EXTENSION", "EXECUTABLE_ATTACHMENT", "SUSPICIOUS_FILENAME"]),
        "my    file.exe": (pe, ["EXECUTABLE_ATTACHMENT", "SUSPICIOUS_FILENAME"]),
        "invoice.js": (None, ["SCRIPT_ATTACHMENT", "SUSPICIOUS_FILENAME"]),
        "noname": (b"", []),
    }
    df = spark.createDataFrame([(n, b) for n, (b, _) in cases.items()], "att_name string, att_bytes binary")
    rows = {r.att_name: r for r in ar.with_attachment_signals(df, max_entries=200).withColumn("r", ar.attachment_result()).collect()}
    assert {n: r.att_flags for n, r in rows.items()} == {n: f for n, (_, f) in cases.items()}
    assert rows["bad.zip"].r.status == "partial" and rows["plain.gz"].r.status == "partial"
    assert rows["bill.pdf.exe"].att_score == 85.0 and rows["bill.pdf.exe"].att_confidence == 0.95
    assert rows["invoice.js"].att_confidence == 0.70 and rows["report.pdf"].att_confidence == 1.0
    keys = [e.key for e in rows["drop.zip"].att_evidence]
    assert keys == sorted(keys) and "archive_single_payload_dropper" in keys


def test_files_and_images(spark):
    eicar = b"X5O!P%@AP[4\\PZX54(P^)7CC)7}$EICAR-STANDARD-ANTIVIRUS-TEST-FILE!$H+H*"
    df = spark.createDataFrame([("a", eicar), ("b", b"other"), ("c", None)], "id string, file_bytes binary")
    df = fs.with_file_report(ind.with_hash_hit(df, feeds.seed_hashes(spark, "x")), None)
    rows = {r.id: r.r for r in df.withColumn("r", fs.malware_result(False)).collect()}
    assert rows["a"].risk_score == 100.0 and "threat_family:EICAR-Standard-AV-Test" in rows["a"].flags
    assert rows["b"].status == "error" and rows["b"].confidence == 0.0 and rows["c"].status == "skipped"
    img = spark.createDataFrame([
        ("qr", True, "http://a.b/c", None, 0, True, True), ("login", True, None, [("Sign In", 0.9)], 2, True, True),
        ("bare", True, None, [("password", 0.9), ("x", 0.1)], 0, True, True), ("none", True, "", [], 0, True, True),
        ("bad", True, None, None, 0, False, True), ("no", False, None, None, None, None, None),
    ], "id string, has_image boolean, qr_text string, ocr array<struct<text:string,conf:double>>, input_fields int,"
       " decode_ok boolean, ocr_ok boolean")
    v = {r.id: r for r in vr.with_visual_signals(img).collect()}
    assert v["qr"].visual_result.risk_score == 20.0 and v["qr"].extracted_url == "http://a.b/c"
    assert v["login"].visual_result.flags == ["ocr_text_extracted", "visual_phishing_detected"]
    assert v["bare"].visual_result.risk_score == 30.0 and v["bare"].extracted_text == "password"
    assert v["none"].visual_result.confidence == 0.9
    assert v["bad"].visual_result.status == "error" and v["no"].visual_result.status == "skipped"


# ------------------------------------------------------------------ fusion
def fused(spark, *results, order=False):
    df = spark.range(1).select(F.array(*results).alias("results"))
    df = fu.with_class(fu.fuse(df), fu.default_profiles(spark), signal=F.col("malware_signal"))
    return ex.explain(df).first()


def res(name, score, conf=1.0, status="success", flags=()):
    return engine_result(name, F.lit(float(score)), conf, F.array(*[F.lit(f) for f in flags]).cast("array<string>"), status=status)


def test_fusion(spark):
    a = fused(spark, res("url_engine", 80), res("nlp_engine", 20, 0.5))
    b = fused(spark, res("nlp_engine", 20, 0.5), res("url_engine", 80))
    assert a.risk_score == b.risk_score == 61.54 and a.classification == "Deceptive"
    assert fused(spark, res("url_engine", 20), res("malware_engine", 100, status="partial")).risk_score == 48.57
    c = fused(spark, res("url_engine", 40), skipped_result("nlp_engine", "x"), error_result("malware_engine", "down"))
    assert c.risk_score == 40.0 and len(c.ignored_engines) == 2
    assert c.warnings == ["malware scan unavailable: down"] and c.reasons[-1] == "malware scan unavailable: down"
    for score, name in [(19.99, "Safe"), (20, "Suspicious"), (44.99, "Suspicious"), (45, "Deceptive"),
                        (69.99, "Deceptive"), (70, "Phishing"), (90, "Phishing")]:
        assert fused(spark, res("url_engine", score)).classification == name
    assert fused(spark, res("malware_engine", 90)).classification == "Malware"
    d = fused(spark, error_result("url_engine", "x"))
    assert (d.risk_score, d.classification, d.confidence) == (0.0, "Safe", 0.0)
    assert d.reasons == [dims.REASON_NO_ENGINE]
    e = fused(spark, res("partner", 95, flags=["vt_malicious"]), res("malware_engine", 95))
    assert e.classification == "Malware" and dims.FLAG_REASONS["vt_malicious"] in e.reasons


def test_profiles(spark):
    rows = [("ok", 10.0, 20.0, 30.0, 40.0, True), ("low", -1.0, 20.0, 30.0, 40.0, True),
            ("order", 10.0, 10.0, 30.0, 40.0, True)]
    good, bad = fu.valid_profiles(spark.createDataFrame(rows, "name string, safe_upper double, suspicious_upper double,"
        " deceptive_upper double, phishing_upper double, malware_requires_signal boolean"))
    assert [r.name for r in good.collect()] == ["ok"]
    assert {r.name: r.reason[:9] for r in bad.collect()} == {"low": "Threshold", "order": "Invalid t"}


def test_triage(spark):
    df = spark.createDataFrame([
        ("u", "http://192.168.1.1@secure-login-verify.xyz/account", None, None, None),
        ("t", None, "URGENT: Your account has been suspended due to unauthorized activity. Please verify your identity immediately.",
         None, "security-alert@fakebank-update.xyz"),
        ("a", None, None, "security_patch.apk", None), ("d", None, None, "urgent_invoice.pdf.exe", None),
        ("c", "https://www.google.com/search?q=weather", "Hello team, let's meet tomorrow at 10 AM for sprint planning.", None, None),
        ("e", None, None, None, None),
    ], "id string, url string, text string, file_name string, sender_id string")
    r = {x.id: x for x in tr.triage(df).collect()}
    assert r["u"].classification == "Phishing" and {"ip_based_host", "at_symbol_present", "suspicious_tld",
                                                    "suspicious_keywords"} <= set(r["u"].flags)
    assert r["t"].risk_score == 95.0 and "suspicious_sender_tld" in r["t"].flags
    assert r["a"].risk_score == 75.0 and r["d"].classification == "Malware"
    assert r["c"].classification == "Safe" and r["c"].reasons == [dims.TRIAGE_REASON_CLEAN]
    assert r["e"].risk_score == 0.0 and all(x.status == "skipped" for x in r["e"].results)


# ------------------------------------------------------------------ the whole scan
def test_scan(spark):
    tables = feeds.seed_indicators(spark, "2024-01-01")
    feed = feeds.manual_url(spark, "http://malicious-distribution-node.ru/payload.exe", "2024-01-01")
    tables = feeds.Indicators(tables.hashes, feeds.upsert(tables.urls, [feed], "url"), tables.allow)
    rows = [
        ("lunch", "Hi there, are we still meeting for lunch at 12?", None, None, None, None),
        ("google", None, "https://www.google.com", None, None, None),
        ("scam", "URGENT! Your account is locked! Please verify your password and send a gift card immediately.",
         None, None, None, None),
        ("spoof", None, None, "spoofed_invoice.exe", b"%PDF-1.4\n%Fake PDF", None),
        ("feed", None, "http://malicious-distribution-node.ru/other", None, None, None),
        ("reject", None, "javascript:alert(1)", None, None, None), ("empty", "  ", None, None, None, None),
        ("mail", "hi", None, None, None, "Bob <bob@corp.com>"),
    ]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)],
        "scan_id string, text string, url string, file_name string, file_bytes binary, sender_id string, arrival_seq long")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("arrival_seq") * 60 + 1_700_000_000))
    out, bad = scan(df, tables, registry=default_registry(tables))
    r = {x.scan_id: x for x in out.collect()}
    assert {x.scan_id: x.prep_error for x in bad.collect()} == {
        "reject": "Invalid or rejected URL: unsupported_scheme_javascript",
        "empty": "ScanInput contains no valid scannable content after normalization."}
    assert r["lunch"].classification == "Safe" and r["google"].classification == "Safe"
    assert r["scam"].classification in ("Phishing", "Deceptive") and r["feed"].classification == "Phishing"
    assert r["spoof"].classification in ("Suspicious", "Deceptive") and "extension_mismatch" in r["spoof"].flags
    assert all(x.total_engines == 7 for x in r.values()) and "new_sender" in r["mail"].flags
    assert len(r) == 6


def test_registry(spark):
    reg = EngineRegistry()
    reg.register("mine", lambda d: (d, engine_result("mine", F.lit(50.0), 1.0, F.array(F.lit("x")))))
    with pytest.raises(ValueError):
        reg.register("mine", lambda d: d)
    df, results = reg.run_all(spark.range(1))
    assert df.select(results.alias("r")).first().r[0].engine_name == "mine"
    reg.unregister("mine")
    assert len(reg) == 0
    rate = lambda row: {"risk_score": 100.0 / row["n"], "confidence": 1.0, "flags": ["own"]}
    reg.register("own", python_engine("own", rate, ["n"]))
    df, results = reg.run_all(spark.createDataFrame([(4,), (0,)], "n int"))
    rows = {r.n: r.r[0] for r in df.select("n", results.alias("r")).collect()}
    assert rows[4].risk_score == 25.0 and rows[4].flags == ["own"]
    assert rows[0].status == "error" and "ZeroDivisionError" in rows[0].error_message


def test_redirects(spark):
    hops = [("http://a.x/1", 302, "/2"), ("http://a.x/2", 301, "http://b.x/"), ("http://c.x/", 302, "http://u:p@d.x/"),
            ("http://10.0.0.1/", 302, "http://e.x/"), ("http://f.x/d/e", 307, "../g"), ("http://h.x/", 200, "http://i.x/")]
    hops += [(f"http://l.x/{i}", 302, f"/{i + 1}") for i in range(10)]
    starts = ["http://a.x/1", "http://c.x/", "http://10.0.0.1/", "http://f.x/d/e", "http://h.x/", "http://l.x/0", None]
    df = spark.createDataFrame([(s,) for s in starts], "url string")
    hops += [("http://z.x/a", 302, "/b"), ("http://z.x/b", 302, "/c"), ("http://z.x/c", 302, "/b")]
    table = spark.createDataFrame(hops, "url string, status int, location string")
    df = df.unionByName(spark.createDataFrame([("http://z.x/a",)], "url string"))
    got = {r.url: r.final_url for r in rd.resolve_redirects(df, table).collect()}
    assert (got["http://l.x/0"], got["http://z.x/a"]) == ("http://l.x/10", "http://z.x/a")
    ends = {r.start: (r.end, r.cyclic) for r in rd.chain_ends(table)[0].collect()}
    assert ends["http://z.x/a"] == ends["http://z.x/b"] == (None, True) and ends["http://c.x/"] == (None, False)
    got = {r.url: r.final_url for r in rd.resolve_redirects(df, table, max_hops=6).collect()}
    assert got.pop("http://z.x/a") == "http://z.x/c"
    assert got == {"http://a.x/1": "http://b.x/", "http://c.x/": "http://c.x/", "http://10.0.0.1/": "http://10.0.0.1/",
                   "http://f.x/d/e": "http://f.x/g", "http://h.x/": "http://h.x/", "http://l.x/0": "http://l.x/6", None: None}


def test_payloads(spark):
    got = one_column(spark, ["aGk=", "aGk", " a G\nk ", "_-8", "a!b", "a", ""], lambda c: F.struct(*scans.decode_payload(c)))
    values = [(bytes(g[0]) if g[0] is not None else None, g[1] is None) for g in got]
    assert values == [(b"hi", True), (b"hi", True), (b"hi", True), (b"\xff\xef", True), (None, False), (None, False), (None, True)]
