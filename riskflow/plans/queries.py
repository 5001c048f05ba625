"""One query per operator over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow import dims
from riskflow.functions import files, text, urls
from riskflow.operators import (
    address_ranges,
    admission,
    attachment_rules,
    dedup,
    explain,
    file_signals,
    fusion,
    header_signals,
    indicators,
    redirects,
    sender_rules,
    text_signals,
    triage,
    url_signals,
    visual_rules,
)
from riskflow.functions.columns import engine_result, no_flags, skipped_result
from riskflow.plans import metrics, views
from riskflow.plans.scan import scan
from riskflow.session import scratch_folder
from riskflow.sources import feedback, feeds, history, mail, scans, share, snapshots, verdicts
from riskflow.sources.feeds import Indicators
from riskflow.streaming import flows

HISTORY_MS = "unix_millis(cast(ts AS TIMESTAMP))"


def _joined(column: str) -> Column:
    return F.array_join(column, ",")


def _r4(column) -> Column:
    return F.round(column, 4)


# ------------------------------------------------------------------ links
def url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    out = urls.normalize_url(views.view(spark, sf, views.RAW_URLS), "url", "clean", max_chars=4096)
    return out.select(
        "page_id", "clean", _joined("clean_warnings").alias("warnings"),
        F.col("clean_error").alias("error"),
    )


def url_flags(spark, sf):
    out = url_signals.with_url_signals(views.view(spark, sf, views.SCAN_URLS))
    return out.select(
        "page_id", _r4("lex_score").alias("lex_score"), _joined("lex_flags").alias("flags"),
        F.array_join(
            F.transform("lex_evidence", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"
        ).alias("evidence"),
    )


def _scored_urls(spark, sf):
    df = url_signals.with_url_signals(views.view(spark, sf, views.SCAN_URLS))
    df = indicators.with_feed_hit(df, views.feed_urls(spark, sf))
    df = indicators.with_allow_list(df, feeds.seed_allow_list(spark))
    df = url_signals.with_reputation(df, None)
    return df.withColumn("r", url_signals.url_result(df))


def url_scored(spark, sf):
    return _scored_urls(spark, sf).select(
        "page_id", _r4("r.risk_score").alias("risk_score"), "r.confidence", "r.status",
        F.array_join(F.array_sort("r.flags"), ",").alias("flags"),
    )


def url_feed_match(spark, sf):
    df = indicators.with_feed_hit(
        views.view(spark, sf, views.SCAN_URLS), views.feed_urls(spark, sf)
    )
    return df.select("page_id", F.col("feed_hit.url").alias("hit_url"),
                     F.col("feed_hit.threat_type").alias("threat_type"))


def url_allowlist(spark, sf):
    df = indicators.with_allow_list(
        views.view(spark, sf, views.SCAN_URLS), feeds.seed_allow_list(spark)
    )
    return df.select("page_id", "allow_listed")


def url_reputation(spark, sf):
    pages = views.view(spark, sf, views.SCAN_URLS)
    table = pages.where("page_id % 6 = 0").selectExpr(
        "url",
        "CASE WHEN page_id % 12 = 0 THEN array('MALWARE', 'SOCIAL_ENGINEERING') ELSE array() END"
        " AS threat_types",
        "CASE WHEN page_id % 18 = 0 THEN 503 ELSE 200 END AS http_status",
    )
    df = url_signals.with_reputation(pages, table)
    return df.select("page_id", "rep_score", _joined("rep_threats").alias("threats"), "rep_error")


def url_domain_age(spark, sf):
    pages = views.table(spark, sf, "pages")
    host = urls.url_host(F.col("url"))
    suffixes = pages.select(F.substring_index(host, ".", -1).alias("suffix")).distinct()
    registered = pages.select(
        F.substring_index(host, ".", -2).alias("domain"),
        F.expr("timestamp'2024-01-01' + make_dt_interval(cast(page_id % 40 as int))").alias("created"),
    )
    df = url_signals.with_domain_age(
        pages.select("page_id", "url"), registered, suffixes, "2024-01-11 00:00:00"
    )
    return df.select("page_id", F.col("domain_age").cast("bigint").alias("domain_age"))


def _hops(spark, sf):
    """Redirects between the pages: chains of 40 hops, a circle, a target with credentials, relative targets."""
    pages = views.table(spark, sf, "pages").select("page_id", F.sha2("url", 256).substr(1, 8).alias("tag"))
    after = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("tag").alias("to"))
    host = "https://go.example.com"
    return pages.join(after, "page_id").selectExpr(
        f"concat('{host}/r/', page_id, '-', tag) AS url",
        "if(page_id % 50 = 49, 404, if(page_id % 2 = 0, 302, 308)) AS status",
        f"""CASE WHEN page_id % 50 = 40 THEN '' WHEN page_id % 50 = 46 THEN concat('https://u:p@go.example.com/r/', page_id + 1, '-', to)
          WHEN page_id % 50 = 44 THEN concat('{host}/r/', page_id, '-', tag)
          WHEN page_id % 3 = 0 THEN concat('../r/./', page_id + 1, '-', to) WHEN page_id % 3 = 1 THEN concat('/r/', page_id + 1, '-', to)
          ELSE concat('{host}/r/', page_id + 1, '-', to) END AS location""",
    )


def redirect_resolve(spark, sf):
    starts = views.table(spark, sf, "pages").selectExpr(
        "page_id", "concat('https://go.example.com/r/', page_id, '-', substr(sha2(url, 256), 1, 8)) AS start_url"
    )
    hops = _hops(spark, sf)
    whole = redirects.resolve_redirects(starts, hops, "start_url")
    six = redirects.resolve_redirects(whole.withColumnRenamed("final_url", "end_url"), hops, "start_url", max_hops=6)
    return six.selectExpr("page_id", "end_url AS final_url", "final_url AS after_six")


def public_address(spark, sf):
    return views.table(spark, sf, "events").select(
        "event_id",
        F.concat_ws(
            ".",
            F.col("event_id") % 256, (F.col("event_id") * 7) % 256, F.col("user_id") % 256,
            F.lit(1),
        ).alias("address"),
    ).select("event_id", urls.is_public_address(F.col("address")).alias("is_public"))


def address_blocks(spark, sf):
    """Longest block of each address, among blocks of every twentieth page, and whether it is public."""
    source = views.page_addresses(lambda e: f"conv({e}, 16, 10)").replace("FROM pages", "FROM {pages}")
    rows = spark.sql(source, pages=views.table(spark, sf, "pages"))
    blocks = rows.where("page_id % 20 = 0").selectExpr(f"concat(address, '/', {views.BLOCK_BITS}) AS cidr", "concat('p', page_id) AS owner")
    out = address_ranges.with_block(rows, "address", blocks)
    return out.select(
        "page_id", urls.is_public_address(F.col("address")).alias("is_public"),
        F.col("block.cidr").alias("cidr"), F.col("block.info.owner").alias("owner"),
    )


# ------------------------------------------------------------------ texts
def text_signal_rules(spark, sf):
    out = text_signals.with_text_signals(views.view(spark, sf, views.TEXT))
    return out.select(
        "doc_id", _r4("text_score").alias("text_score"), _joined("text_flags").alias("flags"),
        _joined("text_phrases").alias("phrases"),
    )


def text_normalize(spark, sf):
    df = views.view(spark, sf, views.TEXT)
    out = df.select("doc_id", text.normalize_text(F.col("text"), max_chars=None).alias("n"))
    return out.select("doc_id", F.col("n.text").alias("text"),
                      _joined("n.warnings").alias("warnings"))


def redact_text(spark, sf):
    df = views.view(spark, sf, views.LINK_TEXT)
    return df.select("doc_id", text.redact(F.col("text"), max_chars=None).alias("redacted"))


def mostly_redacted(spark, sf):
    df = views.view(spark, sf, views.LINK_TEXT).withColumn(
        "safe", text.redact(F.col("text"), max_chars=None)
    )
    return df.select("doc_id", text.mostly_redacted(F.col("text"), F.col("safe")).alias("mostly"))


def safe_keys(spark, sf):
    df = views.table(spark, sf, "pages")
    return df.select("page_id", text.safe_key(F.col("url")).alias("key"))


def url_extract(spark, sf):
    df = views.view(spark, sf, views.LINK_TEXT)
    return df.select(
        "doc_id", F.array_join(urls.extract_mail_urls(F.col("text")), " ").alias("urls"),
        urls.first_share_url(F.col("text")).alias("first_url"),
    )


def url_extract_html(spark, sf):
    df = views.table(spark, sf, "pages")
    body = F.concat("html", F.lit(" source "), "url", F.lit("."))
    found = df.select("page_id", F.posexplode(urls.extract_mail_urls(body)))
    return found.select("page_id", F.col("pos").cast("bigint").alias("pos"), F.col("col").alias("link"))


def url_extract_screen(spark, sf):
    df = views.view(spark, sf, views.LINK_TEXT)
    return df.select(
        "doc_id", F.array_join(urls.extract_screen_urls(F.col("text")), " ").alias("urls")
    )


def html_to_text(spark, sf):
    df = views.table(spark, sf, "pages")
    return df.select("page_id", text.html_to_text(F.col("html")).alias("text"))


def screen_text(spark, sf):
    df = views.view(spark, sf, views.SCREEN)
    return df.select("conv_id", "turn", text.suspicious_snippet(F.col("text")).alias("snippet"))


# ------------------------------------------------------------------ headers and senders
def header_rules(spark, sf):
    out = header_signals.with_header_signals(views.view(spark, sf, views.HEADERS))
    return out.select(
        "scan_id", _r4("header_score").alias("header_score"),
        F.array_join(F.array_sort("header_flags"), ",").alias("flags"),
    )


def sender_rule_flags(spark, sf):
    df = sender_rules.with_sender_signals(
        sender_rules.with_sender_history(views.messages(spark, sf))
    )
    return df.select(
        "arrival_seq", _r4("sender_score").alias("sender_score"), "sender_confidence",
        F.array_join(F.array_sort("sender_flags"), ",").alias("flags"),
    )


def sender_odd_hour(spark, sf):
    """The hour-of-day rule on uncompressed time."""
    df = sender_rules.with_sender_signals(
        sender_rules.with_sender_history(views.messages(spark, sf, compressed=False))
    )
    return df.select("arrival_seq", F.array_contains("sender_flags", "unusual_time").alias("odd"))


def sender_anchored_hour(spark, sf):
    df = sender_rules.with_sender_history(views.messages(spark, sf))
    return df.select("arrival_seq", "recent_count", "recent_start_us")


def sender_snapshot(spark, sf):
    return _profile_rows(sender_rules.sender_snapshot(views.messages(spark, sf)))


def _profile_rows(df):
    buckets = F.array_join(
        F.transform(
            F.map_entries("time_buckets"),
            lambda e: F.concat(F.lpad(e["key"], 2, "0"), F.lit("="), e["value"].cast("string")),
        ),
        ",",
    )
    ordered = F.array_join(F.array_sort(F.split(buckets, ",")), ",")
    return df.withColumn("time_buckets", ordered)


def _halves(spark, sf):
    rows = views.messages(spark, sf)
    middle = rows.agg(F.expr("max(arrival_seq) div 2")).first()[0]
    return rows.where(F.col("arrival_seq") < middle), rows.where(F.col("arrival_seq") >= middle)


def sender_handover(spark, sf):
    """The rules on the later half of the messages, with the state that the earlier half left."""
    early, late = _halves(spark, sf)
    state = sender_rules.sender_state(early)
    df = sender_rules.with_sender_signals(sender_rules.with_sender_history(late, state=state))
    return df.select(
        "arrival_seq", _r4("sender_score").alias("sender_score"), "recent_count", "recent_start_us",
        F.array_join(F.array_sort("sender_flags"), ",").alias("flags"),
    )


def sender_state_fold(spark, sf):
    """Profiles and names after both halves, the second folded into the state of the first."""
    early, late = _halves(spark, sf)
    state = sender_rules.sender_state(late, sender_rules.sender_state(early))
    profiles = _profile_rows(state.profiles).selectExpr(
        "client_id", "profile_key AS name", "message_count AS count", "last_seen_us", "last_domain",
        "concat_ws('|', link_count, file_count, first_seen_us, recent_count, recent_window_start_us, time_buckets) AS more",
    )
    return profiles.unionByName(state.names.selectExpr(
        "client_id", "display_name AS name", "count", "last_seen_us", "last_domain", "last_email AS more"
    ))


def sender_names(spark, sf):
    return sender_rules.name_snapshot(views.messages(spark, sf))


def sender_evict(spark, sf):
    rows = views.messages(spark, sf)
    profiles = rows.groupBy("client_id", "sender_raw").agg(F.max("t_us").alias("last_seen_us"))
    return sender_rules.evict_oldest(profiles, ["client_id", "sender_raw"], limit=100, drop=20)


# ------------------------------------------------------------------ files
def hash_match(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("file_bytes"))
    feed = (
        views.table(spark, sf, "documents").where("doc_id % 50 = 3")
        .select(F.sha2(F.col("text"), 256).alias("sha256"), F.lit("Test.Family").alias("signature"),
                F.lit("txt").alias("file_type"), F.lit("Test.Av").alias("clamav"),
                F.lit(90.0).alias("vt_percent"), F.lit("2024-01-01").alias("first_seen"),
                F.lit("MalwareBazaar").alias("source"))
    )
    df = file_signals.with_file_report(indicators.with_hash_hit(docs, feed), None)
    df = df.withColumn("r", file_signals.malware_result(False))
    return df.select("doc_id", "sha256", "r.risk_score", "r.confidence", "r.status",
                     _joined("r.flags").alias("flags"))


def file_reports(spark, sf):
    docs = views.table(spark, sf, "documents").select(
        "doc_id", F.encode("text", "UTF-8").alias("file_bytes"), "text"
    )
    reports = docs.where("doc_id % 2 = 0").select(
        F.sha2(F.col("text"), 256).alias("sha256"),
        (F.length("text") % 5).cast("bigint").alias("malicious"),
        (F.length("text") % 3).cast("bigint").alias("suspicious"),
        F.lit(40).cast("bigint").alias("undetected"), F.lit(10).cast("bigint").alias("harmless"),
        F.lit(200).alias("http_status"),
    )
    df = indicators.with_hash_hit(docs.drop("text"), feeds.seed_hashes(spark, "2024-01-01"))
    df = file_signals.with_file_report(df, reports)
    df = df.withColumn("r", file_signals.malware_result(True))
    return df.select("doc_id", _r4("r.risk_score").alias("risk_score"), "r.confidence", "r.status",
                     _joined("r.flags").alias("flags"))


def _file_rows(spark, sf):
    return views.view(spark, sf, views.FILES).select(
        "doc_id", "att_name", F.encode("body", "UTF-8").alias("att_bytes")
    )


def attachment_rule_flags(spark, sf):
    df = attachment_rules.with_attachment_signals(_file_rows(spark, sf))
    return df.select("doc_id", "att_type", "att_score", "att_confidence",
                     _joined("att_flags").alias("flags"))


def archive_rules(spark, sf):
    """Archives whose entries are the lines of the documents, nested ones included."""
    from riskflow.operators import archive_rules as rules

    entries = views.archive_entries(spark, sf)
    found = rules.archive_findings(entries, max_entries=40).groupBy("file_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "key", F.concat_ws(":", "count", "value")))), "; ").alias("findings")
    )
    return rules.archive_verdicts(entries, max_entries=40).join(found, "file_id", "left").select(
        "file_id", "entries", _joined("flags").alias("flags"), "score", F.coalesce("findings", F.lit("")).alias("findings")
    )


def file_type_check(spark, sf):
    df = _file_rows(spark, sf)
    return df.select(
        "doc_id",
        F.coalesce(files.signature("att_bytes", "ext"), F.lit("unknown")).alias("actual_ext"),
        files.extension_mismatch("att_bytes", F.col("att_name")).alias("mismatch"),
    )


def payload_decode(spark, sf):
    """Base64 texts in both alphabets, with line breaks and without padding."""
    docs = views.table(spark, sf, "documents").withColumn(
        "b64", F.base64(F.encode("text", "UTF-8"))
    )
    sent = docs.withColumn(
        "sent",
        F.when(F.col("doc_id") % 3 == 0, F.translate("b64", "+/=", "-_"))
        .when(F.col("doc_id") % 7 == 1, F.concat("b64", F.lit("!")))
        .otherwise(F.concat(F.lit(" "), "b64", F.lit("\n"))),
    )
    content, error = scans.decode_payload(F.col("sent"))
    return sent.select("doc_id", F.sha2(content, 256).alias("sha256"), error.alias("error"))


def image_rules(spark, sf):
    df = views.table(spark, sf, "documents").select(
        "doc_id",
        F.lit(True).alias("has_image"),
        F.expr("CASE doc_id % 4 WHEN 0 THEN concat('https://qr.example.com/', doc_id) WHEN 1 THEN 'plain code' END").alias("qr_text"),
        F.expr("CASE WHEN doc_id % 3 = 0 THEN array(named_struct('text', 'Sign in with your password', 'conf', 0.9D),"
               " named_struct('text', 'blurred', 'conf', 0.2D)) WHEN doc_id % 3 = 1 THEN"
               " array(named_struct('text', concat('hello ', doc_id), 'conf', 0.8D)) END").alias("ocr"),
        (F.col("doc_id") % 2).cast("int").alias("input_fields"),
        (F.col("doc_id") % 11 != 0).alias("decode_ok"),
        F.lit(True).alias("ocr_ok"),
    )
    out = visual_rules.with_visual_signals(df)
    return out.select(
        "doc_id", F.col("visual_result.risk_score").alias("risk_score"),
        F.col("visual_result.status").alias("status"),
        F.array_join("visual_result.flags", ",").alias("flags"), "extracted_text", "extracted_url",
    )


# ------------------------------------------------------------------ fusion and verdicts
def _two_engines(spark, sf):
    """Text and link results of one scan per document."""
    links = _scored_urls(spark, sf).select(F.col("page_id").alias("doc_id"), F.col("r").alias("u"))
    texts = text_signals.with_text_signals(views.view(spark, sf, views.TEXT))
    texts = texts.withColumn("t", text_signals.text_result()).select("doc_id", "t")
    both = texts.join(links, "doc_id", "left")
    no_link = skipped_result(dims.URL_ENGINE, "No URL provided")
    no_file = skipped_result(dims.MALWARE_ENGINE, "No file bytes provided")
    return both.withColumn("results", F.array(F.coalesce("u", no_link), "t", no_file)).drop("u", "t")


def fuse_verdict(spark, sf):
    df = fusion.fuse(_two_engines(spark, sf))
    df = fusion.with_class(df, fusion.default_profiles(spark), signal=F.col("malware_signal"))
    return df.select(
        "doc_id", "risk_score", "confidence", "classification", _joined("flags").alias("flags"),
        _joined("contributing_engines").alias("used"), _joined("ignored_engines").alias("ignored"),
    )


def fuse_long(spark, sf):
    """The same score from a long table with one more, unknown engine per scan."""
    wide = _two_engines(spark, sf)
    extra = engine_result("partner_engine", (F.col("doc_id") % 100).cast("double"), 0.6, no_flags())
    long = wide.select("doc_id", F.explode(F.array_append("results", extra)).alias("r")).select(
        "doc_id", "r.*"
    )
    return fusion.fuse_long(long, "doc_id").select("doc_id", "risk_score", "confidence")


def verdict_by_profile(spark, sf):
    df = fusion.fuse(_two_engines(spark, sf))
    names = F.array(*[F.lit(p) for p in ("default", " STRICT ", "enterprise", "other")])
    df = df.withColumn("profile", F.element_at(names, (F.col("doc_id") % 4 + 1).cast("int")))
    df = fusion.with_class(df, fusion.default_profiles(spark), F.col("profile"))
    return df.groupBy("profile", "classification").agg(F.count(F.lit(1)).alias("scans"))


def explain_reasons(spark, sf):
    texts = text_signals.with_text_signals(views.view(spark, sf, views.TEXT))
    df = texts.withColumn(
        "results",
        F.array(
            text_signals.text_result(), skipped_result(dims.MALWARE_ENGINE, "No file bytes provided")
        ),
    ).select("doc_id", "results")
    df = fusion.with_class(
        fusion.fuse(df), fusion.default_profiles(spark), signal=F.col("malware_signal")
    )
    out = explain.explain(df)
    return out.select("doc_id", F.array_join("reasons", " | ").alias("reasons"), "recommended_action")


def url_flag_reasons(spark, sf):
    df = url_signals.with_url_signals(views.view(spark, sf, views.SCAN_URLS))
    found = df.select(F.explode("lex_flags").alias("flag"))
    reason = explain.flag_reason(F.col("flag"))
    return found.groupBy("flag").agg(F.count(F.lit(1)).alias("links")).withColumn("reason", reason)


def _scan_rows(spark, sf):
    """One scan per document: text, some with a link, a sender and headers."""
    docs = views.view(spark, sf, views.TEXT).join(
        views.view(spark, sf, views.SCAN_URLS).withColumnRenamed("page_id", "doc_id"),
        "doc_id", "left",
    )
    return docs.select(
        F.concat(
            F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("doc_id").cast("string"), 12, "0")
        ).alias("scan_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 30).alias("ts"),
        F.col("doc_id").alias("arrival_seq"),
        "text",
        "url",
        F.concat(F.lit("User <u"), F.col("doc_id") % 50, F.lit("@mail.example.com>")).alias("sender_id"),
        F.concat(F.lit("c"), F.col("doc_id") % 3).alias("client_id"),
        F.expr("map('From', concat('u', doc_id % 50, '@mail.example.com'),"
               " 'Message-ID', concat('<', doc_id, '@mail.example.com>'),"
               " 'spf', CASE WHEN doc_id % 20 = 0 THEN 'fail' ELSE 'pass' END)").alias("headers"),
        F.expr("CASE WHEN doc_id % 10 = 0 THEN concat('invoice', doc_id, '.pdf.exe') END").alias("file_name"),
        F.expr("CASE WHEN doc_id % 10 = 0 THEN encode(concat('MZ', text), 'UTF-8') END").alias("file_bytes"),
    )


def _scanned(spark, sf):
    tables = Indicators(
        feeds.seed_hashes(spark, "2024-01-01"), views.feed_urls(spark, sf), feeds.seed_allow_list(spark)
    )
    return scan(_scan_rows(spark, sf), tables)[0]


def scan_assessments(spark, sf):
    """Fused verdicts of full scans: all engines, classes, actions, engine counts and warnings."""
    return _scanned(spark, sf).select(
        "scan_id", "risk_score", "classification", "confidence", "recommended_action",
        _joined("flags").alias("flags"), F.col("total_engines").cast("bigint").alias("total_engines"),
        F.col("skipped_engines").cast("bigint").alias("skipped_engines"),
        _joined("contributing_engines").alias("used"), F.array_join("warnings", " | ").alias("warnings"),
    )


def scan_verdicts(spark, sf):
    return _scanned(spark, sf).select(
        "scan_id", "risk_score", "classification", "confidence", "recommended_action",
        _joined("flags").alias("flags"), F.array_join("reasons", " | ").alias("reasons"),
        F.col("total_engines").cast("bigint").alias("total_engines"),
        F.col("skipped_engines").cast("bigint").alias("skipped_engines"),
    )


def verdict_counts(spark, sf):
    """Links scored, fused and counted by class."""
    df = _scored_urls(spark, sf).withColumn("results", F.array("r")).drop(
        "flags", "evidence", "risk_score"
    )
    df = fusion.with_class(
        fusion.fuse(df), fusion.default_profiles(spark), signal=F.col("malware_signal")
    )
    return df.groupBy("classification").agg(
        F.count(F.lit(1)).alias("links"), F.round(F.avg("risk_score"), 4).alias("mean_score")
    )


def scan_requests(spark, sf):
    """JSON requests with nested metadata of several shapes, as the engines see them."""
    text_json = "substr(to_json(array(text)), 2, length(to_json(array(text))) - 2)"
    lines = views.table(spark, sf, "documents").selectExpr(
        "doc_id",
        f"""concat('{{"scan_id":"s', doc_id, '","text":', {text_json}, ',"metadata":', CASE doc_id % 6
          WHEN 0 THEN concat('{{"headers":{{"From":"a', doc_id, '@x.org","Received":["from h1",":from h', doc_id, '"]}},"timestamp":', doc_id, '.5}}')
          WHEN 1 THEN concat('{{"headers":{{"from":"b@x.org","Reply-To":"c', doc_id, '@y.org"}},"attachments":[{{"filename":"inv', doc_id,
            '.exe","content":"', replace(base64(encode(text, 'UTF-8')), '\r\n', ''), '"}},{{"name":"second"}}],"timestamp":"', doc_id, '"}}')
          WHEN 2 THEN concat('{{"files":{{"file_name":"f', doc_id, '.js","bytes":"TVo="}},"sender_domain":"z', doc_id, '.org","client_id":"c', doc_id, '"}}')
          WHEN 3 THEN '{{"Date":"Mon, 1 Jan 2024 00:00:00 +0000","Message-ID":"<m@x.org>","profile":"strict","nested":{{"a":[1,2]}}}}'
          WHEN 4 THEN '"only text"' ELSE '{{"broken":' END, '}}') AS value""",
    )
    good, bad = scans.decode_scans(scans.parse_scan_requests(lines))
    seen = attachment_rules.pick_attachment(header_signals.with_headers(scans.complete_scans(good)))
    out = seen.select(
        "doc_id", "scan_id", F.md5("text").alias("text_md5"), "meta_ts", "has_headers", "h_from", "h_reply_to", "h_date", "h_message_id",
        F.array_join("received", ";").alias("received"), "sender_domain", "client_id", "att_name", F.md5("att_bytes").alias("att_md5"),
        scans.profile_name(seen).alias("profile"), F.try_element_at("metadata", F.lit("nested")).alias("nested"),
    ).withColumn("reject_reason", F.lit(None).cast("string"))
    return out.unionByName(bad.select("doc_id", "reject_reason"), allowMissingColumns=True)


def profile_check(spark, sf):
    """Profiles made of document lengths, with the reason of those that are turned down."""
    rows = views.table(spark, sf, "documents").selectExpr(
        "if(doc_id % 13 = 0, ' ', concat('P', doc_id div 2, if(doc_id % 2 = 0, ' ', ''))) AS name", "cast(n_chars % 60 AS double) - 2 AS safe_upper",
        "cast(n_chars % 60 + doc_id % 30 AS double) AS suspicious_upper", "cast(n_chars % 60 + doc_id % 30 + doc_id % 7 AS double) AS deceptive_upper",
        "cast(n_chars % 60 + 40 AS double) AS phishing_upper", "true AS malware_requires_signal",
    )
    good, bad = fusion.valid_profiles(rows)
    return good.withColumn("reason", F.lit("")).unionByName(bad).groupBy("reason").agg(
        F.count(F.lit(1)).alias("profiles"), F.sum("safe_upper").alias("safe_sum"), F.min("name").alias("first_name")
    )


def scan_gate(spark, sf):
    """Outcome of preprocessing for raw links."""
    rows = views.view(spark, sf, views.RAW_URLS).select(
        F.col("page_id").cast("string").alias("scan_id"), "url"
    )
    out = scans.preprocess(rows, max_url=4096)
    return out.select("scan_id", "prep_status", "prep_error", _joined("prep_warnings").alias("warnings"))


def triage_verdict(spark, sf):
    links = views.view(spark, sf, views.SCAN_URLS)
    docs = views.view(spark, sf, views.TEXT).select(F.col("doc_id").alias("page_id"), "text")
    out = triage.triage(links.join(docs, "page_id", "left"))
    return out.select("page_id", "risk_score", "classification", _joined("flags").alias("flags"))


def verdict_with_fallback(spark, sf):
    """Every third link has a full verdict, one of them malformed."""
    links = views.view(spark, sf, views.SCAN_URLS).withColumn(
        "scan_id", F.col("page_id").cast("string")
    )
    triaged = triage.triage(links)
    docs = links.where("page_id % 3 = 0").select(
        "scan_id",
        F.expr(
            """concat('{"scan_id":"', scan_id, '","status":"completed","total_engines":7,"completed_engines":1,
"skipped_engines":6,"risk_score":', CASE WHEN page_id % 30 = 0 THEN '"x"' ELSE cast(page_id % 100 as string) END,
',"classification":"Deceptive","results":[],"risk_assessment":{"risk_score":1.5,"classification":"Safe","confidence":0.5,
"contributing_engines":[],"ignored_engines":[],"flags":[],"evidence":[],"reasons":["r"],"recommended_action":"act"}}')"""
        ).alias("body"),
    )
    good, _ = verdicts.check_verdicts(docs)
    full = good.select(
        "scan_id", "verdict.risk_score", "verdict.classification",
        F.col("verdict.risk_assessment.recommended_action").alias("recommended_action"),
        F.coalesce("verdict.warnings", no_flags()).alias("warnings"),
    )
    out = triage.with_fallback(triaged, full)
    return out.select("page_id", "risk_score", "classification", "is_fallback")


# ------------------------------------------------------------------ feedback and history
def feedback_first_wins(spark, sf):
    return feedback.first_votes(views.feedback(spark, sf)).drop("confidence_at_scan_time")


def feedback_validate(spark, sf):
    _, bad = feedback.validate(feedback.adapt_legacy(views.feedback(spark, sf)))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("votes"))


def feedback_inserted(spark, sf):
    votes = views.feedback(spark, sf)
    stored = votes.where("arrival_seq % 10 = 0").select("scan_id")
    return feedback.mark_inserted(votes, stored).select("arrival_seq", "inserted")


def feedback_metrics(spark, sf):
    out = metrics.feedback_totals(feedback.first_votes(views.feedback(spark, sf)))
    return out.select(*[
        _r4(c).alias(c) if c.startswith("average") or c.endswith("rate") else F.col(c)
        for c in out.columns
    ])


def feedback_by_class(spark, sf):
    out = metrics.feedback_by_class(feedback.first_votes(views.feedback(spark, sf)))
    return out.withColumns({c: _r4(c) for c in ("positive_rate", "negative_rate")})


def feedback_by_source(spark, sf):
    return metrics.feedback_by_source(feedback.first_votes(views.feedback(spark, sf)))


def _history(spark, sf):
    return views.view(spark, sf, views.HISTORY).withColumn("timestamp_millis", F.expr(HISTORY_MS)).drop("ts")


def history_page(spark, sf):
    return history.history_page(_history(spark, sf), limit=50, offset=10, classification="Phishing",
                                source_type="URL")


def history_lookup(spark, sf):
    return history.history_row(_history(spark, sf), "00000000-0000-4000-8000-000000000042")


def history_stats(spark, sf):
    return metrics.history_stats(_history(spark, sf))


def history_records(spark, sf):
    """Sanitized history rows of triage verdicts."""
    rows = _scan_rows(spark, sf).select("scan_id", "ts", "text", "url", "sender_id")
    out = history.history_records(
        triage.triage(rows), F.lit("Gmail"), F.unix_millis("ts")
    )
    return out.select("scan_id", "timestamp_millis", "source_type", "classification", "risk_score",
                      _joined("flags").alias("flags"))


def history_feedback_state(spark, sf):
    rows = _history(spark, sf).withColumn("feedback_state", F.lit(None).cast("string"))
    updates = rows.select(
        "scan_id",
        F.expr("CASE timestamp_millis % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'maybe' END").alias("feedback_state"),
    )
    out = history.update_feedback(rows, updates)
    return out.groupBy("feedback_state").agg(F.count(F.lit(1)).alias("scans"))


def history_delete(spark, sf):
    rows = _history(spark, sf)
    return history.delete_scans(rows, rows.where("source_type = 'share'")).groupBy("source_type").agg(
        F.count(F.lit(1)).alias("scans")
    )


def inbox_summary(spark, sf):
    return metrics.inbox_summary(_history(spark, sf))


def inbox_latest(spark, sf):
    return metrics.inbox_latest(_history(spark, sf))


def watch_alerts(spark, sf):
    """Alerts of the link watch (any class but Safe) and of the inbox check."""
    rows = _history(spark, sf)
    return rows.select(
        "scan_id",
        flows.is_watch_alert().alias("watch_alert"),
        flows.is_inbox_alert().alias("inbox_alert"),
    ).where("watch_alert or inbox_alert")


def link_watch(spark, sf):
    """Gate of the link watch over screens made of events; every fifth scan fails after 20 seconds."""
    screens = views.view(spark, sf, views.WATCH_SCREENS).withColumn("t_us", F.expr(views.T_US_SPARK))
    failed = flows.watch_targets(screens).where("arrival_seq % 5 = 0").withColumn("t_us", F.col("t_us") + 20_000_000)
    out = flows.link_watch_rows(screens, failed, ttl_us=1_200_000_000, limit=2, window_us=300_000_000)
    return out.select("device_id", "arrival_seq", F.col("position").cast("bigint").alias("position"), "url", "accepted")


# ------------------------------------------------------------------ repeats, admission, sessions
def pending_messages(spark, sf):
    rows = views.table(spark, sf, "events").select(F.col("event_id").alias("message_id"), "user_id")
    done = rows.where("message_id % 3 = 0 AND user_id % 2 = 0").select("message_id")
    return dedup.pending(rows, done)


def last_500(spark, sf):
    rows = views.table(spark, sf, "events").select(
        F.concat(F.lit("m"), F.col("event_id") % 4000).alias("message_id"), F.col("event_id").alias("seq")
    )
    return dedup.keep_latest_ids(rows, "message_id", "seq")


def debounce(spark, sf):
    rows = views.table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("window_id"),
        F.col("event_type").alias("content"),
    )
    return dedup.debounce(rows, "window_id", "content", "seq")


def _repeats(spark, sf):
    return views.messages(spark, sf).select(
        "arrival_seq", "t_us", F.concat(F.lit("k"), F.regexp_extract("sender_raw", "<u(\\d+)@", 1)).alias("key"),
        (F.col("arrival_seq") % 4 != 0).alias("scan_ok"),
    )


def ttl_dedup(spark, sf):
    out = dedup.ttl_dedup(_repeats(spark, sf), "key", "t_us", "arrival_seq", succeeded="scan_ok")
    return out.select("arrival_seq", "accepted")


def admission_server(spark, sf):
    rows = _repeats(spark, sf)
    out = admission.admit(rows, ["key"], "t_us", "arrival_seq", limit=3, window_us=600_000_000)
    return out.select("arrival_seq", "allowed", "retry_after")


def admission_client(spark, sf):
    rows = _repeats(spark, sf)
    out = admission.admit(
        rows, ["key"], "t_us", "arrival_seq", limit=2, window_us=600_000_000, inclusive=False
    )
    return out.select("arrival_seq", "allowed")


def admission_request(spark, sf):
    rows = _repeats(spark, sf).withColumn("ip", F.concat(F.lit("10.0.0."), F.col("arrival_seq") % 7))
    out = admission.admit_request(rows, "ip", "key", "t_us", "arrival_seq", limit=30, window_us=60_000_000)
    return out.select("arrival_seq", "allowed")


def live_session_join(spark, sf):
    users = views.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("full_name")
    )
    rows = views.table(spark, sf, "events")
    sessions = rows.groupBy("user_id").agg(F.min("ts").alias("first_ts")).select(
        F.concat(F.lit("tok"), "user_id").alias("token"), "user_id",
        F.expr("first_ts + interval 10 days").alias("expires_at"),
    )
    events = rows.select("event_id", F.concat(F.lit(" tok"), "user_id").alias("token"), "ts")
    return dedup.live_sessions(events, users, sessions).select("event_id", "user_id", "full_name")


# ------------------------------------------------------------------ feeds, mail, shares
def feed_upsert(spark, sf):
    stored = views.feed_urls(spark, sf)
    load = (
        views.table(spark, sf, "pages").where("page_id % 50 = 9")
        .select("url", urls.url_host(F.col("url")).alias("domain"), F.lit("phishing").alias("threat_type"),
                F.lit("openphish").alias("tags"), F.lit("online").alias("url_status"),
                F.lit("2024-02-01").alias("first_seen"), F.lit("OpenPhish").alias("source"))
        .dropDuplicates(["url"])
    )
    return feeds.upsert(stored, [load], "url").select("url", "domain", "threat_type", "source")


def feed_file_lines(spark, sf):
    """A comma-separated feed written from pages in order of their number, read back and published."""
    lines = views.table(spark, sf, "pages").orderBy("page_id").selectExpr(views.FEED_LINE)
    landed = scratch_folder(spark, "feed-lines")
    lines.write.mode("overwrite").text(landed)
    load = feeds.read_urlhaus(spark, landed, "2024-02-01")
    stored = views.feed_urls(spark, sf)
    made = snapshots.publish(spark, scratch_folder(spark, "feed-versions"), {"urls": feeds.upsert(stored, [load], "url")})
    return made.read("urls").select("url", "domain", "threat_type", "tags", "source")


def feed_counts(spark, sf):
    return feeds.counts_by_source(feed_upsert(spark, sf))


def feed_stats(spark, sf):
    tables = Indicators(
        feeds.seed_hashes(spark, "2024-01-01"), views.feed_urls(spark, sf), feeds.seed_allow_list(spark)
    )
    return feeds.statistics(tables)


def _mails(spark, sf):
    docs = views.view(spark, sf, views.LINK_TEXT)
    return docs.selectExpr(
        "concat('m', doc_id) AS message_id",
        "map('From', concat('u', doc_id, '@example.com'), 'Subject', concat('Note ', doc_id)) AS headers",
        """CASE WHEN doc_id % 13 = 0 THEN array() ELSE array(
          named_struct('mime', 'text/plain; x=1', 'filename', '', 'attachment_id', cast(null as string),
            'headers', map('Content-Type', 'text/plain; charset=utf-8'),
            'data', replace(replace(base64(encode(text, 'UTF-8')), '+', '-'), '/', '_')),
          named_struct('mime', 'text/html', 'filename', 'a.html', 'attachment_id', cast(null as string),
            'headers', map('Content-Type', 'text/html'), 'data', 'PGI-')) END AS parts""",
    )


def mail_extract(spark, sf):
    out = mail.extract_mail(_mails(spark, sf))
    return out.select("message_id", "status", "sender", "subject", "body_text",
                      F.array_join("urls", " ").alias("urls"))


def mail_scans(spark, sf):
    out = mail.mail_to_scans(mail.extract_mail(_mails(spark, sf)))
    return out.select("scan_id", "text", "url", "sender_id", "source_channel")


def mail_fetch_summary(spark, sf):
    return mail.fetch_summary(mail.extract_mail(_mails(spark, sf)))


def share_routes(spark, sf):
    docs = views.view(spark, sf, views.LINK_TEXT)
    rows = docs.selectExpr(
        "doc_id",
        "CASE WHEN doc_id % 17 = 0 THEN 'android.intent.action.VIEW' ELSE 'android.intent.action.SEND' END AS action",
        "CASE doc_id % 5 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/json; v=1' WHEN 2 THEN 'image/png' END AS mime_type",
        "CASE WHEN doc_id % 7 <> 3 THEN text END AS text",
        "CASE WHEN doc_id % 4 = 1 THEN 'content://x' END AS stream_uri",
        "CASE WHEN doc_id % 3 = 0 THEN concat('http://data.example.com/', doc_id) END AS data_uri",
        "'f.txt' AS file_name",
        "CASE WHEN doc_id % 8 = 1 THEN '' ELSE 'abc' END AS file_content",
        "cast(null as string) AS file_error",
    )
    return share.route_shares(rows).select("doc_id", "kind", "scan_url", "reject_reason")


QUERIES = {
    "url_normalize": url_normalize,
    "url_flags": url_flags,
    "url_scored": url_scored,
    "url_feed_match": url_feed_match,
    "url_allowlist": url_allowlist,
    "url_reputation": url_reputation,
    "url_domain_age": url_domain_age,
    "url_extract": url_extract,
    "url_extract_html": url_extract_html,
    "url_extract_screen": url_extract_screen,
    "url_flag_reasons": url_flag_reasons,
    "redirect_resolve": redirect_resolve,
    "public_address": public_address,
    "address_blocks": address_blocks,
    "text_signals": text_signal_rules,
    "text_normalize": text_normalize,
    "redact_text": redact_text,
    "mostly_redacted": mostly_redacted,
    "safe_keys": safe_keys,
    "html_to_text": html_to_text,
    "screen_text": screen_text,
    "header_signals": header_rules,
    "sender_rules": sender_rule_flags,
    "sender_odd_hour": sender_odd_hour,
    "sender_anchored_hour": sender_anchored_hour,
    "sender_snapshot": sender_snapshot,
    "sender_names": sender_names,
    "sender_handover": sender_handover,
    "sender_state_fold": sender_state_fold,
    "sender_evict": sender_evict,
    "hash_match": hash_match,
    "file_reports": file_reports,
    "attachment_rules": attachment_rule_flags,
    "file_type_check": file_type_check,
    "archive_rules": archive_rules,
    "payload_decode": payload_decode,
    "visual_rules": image_rules,
    "fuse_verdict": fuse_verdict,
    "fuse_long": fuse_long,
    "verdict_by_profile": verdict_by_profile,
    "verdict_counts": verdict_counts,
    "explain_reasons": explain_reasons,
    "scan_requests": scan_requests,
    "profile_check": profile_check,
    "scan_gate": scan_gate,
    "scan_verdicts": scan_verdicts,
    "scan_assessments": scan_assessments,
    "triage_verdict": triage_verdict,
    "verdict_with_fallback": verdict_with_fallback,
    "feedback_first_wins": feedback_first_wins,
    "feedback_validate": feedback_validate,
    "feedback_inserted": feedback_inserted,
    "feedback_metrics": feedback_metrics,
    "feedback_by_class": feedback_by_class,
    "feedback_by_source": feedback_by_source,
    "history_page": history_page,
    "history_lookup": history_lookup,
    "history_stats": history_stats,
    "history_records": history_records,
    "history_feedback_state": history_feedback_state,
    "history_delete": history_delete,
    "inbox_summary": inbox_summary,
    "inbox_latest": inbox_latest,
    "watch_alerts": watch_alerts,
    "link_watch": link_watch,
    "pending_messages": pending_messages,
    "last_500": last_500,
    "debounce": debounce,
    "ttl_dedup": ttl_dedup,
    "admission_server": admission_server,
    "admission_client": admission_client,
    "admission_request": admission_request,
    "live_session_join": live_session_join,
    "feed_upsert": feed_upsert,
    "feed_file_lines": feed_file_lines,
    "feed_counts": feed_counts,
    "feed_stats": feed_stats,
    "mail_extract": mail_extract,
    "mail_scans": mail_scans,
    "mail_fetch_summary": mail_fetch_summary,
    "share_routes": share_routes,
}
