"""Table and struct types shared by batch and streaming jobs."""

from __future__ import annotations

EVIDENCE = "struct<key:string,value:string,description:string>"
ENGINE_RESULT = (
    "struct<engine_name:string,risk_score:double,confidence:double,flags:array<string>,"
    f"evidence:array<{EVIDENCE}>,status:string,error_message:string,"
    "metadata:map<string,string>>"
)

SCANS = (
    "scan_id string, ts timestamp, arrival_seq bigint, text string, url string,"
    " sender_id string, source_channel string, file_name string, file_bytes binary,"
    " image_bytes binary, headers map<string,string>, received array<string>,"
    " meta_ts double, sender_domain string,"
    " attachments array<struct<name:string,content:binary>>, metadata map<string,string>,"
    " classification_profile string, client_id string"
)
# The same request as it arrives over JSON: binary fields are base64 text, metadata has any shape.
SCAN_REQUESTS = SCANS.replace("file_bytes binary", "file_bytes string").replace(
    "image_bytes binary", "image_bytes string"
).replace("content:binary", "content:string").replace("metadata map<string,string>", "metadata variant")

HASHES = (
    "sha256 string, signature string, file_type string, clamav string, vt_percent double,"
    " first_seen string, source string"
)
FEED_URLS = (
    "url string, domain string, threat_type string, tags string, url_status string,"
    " first_seen string, source string"
)
ALLOW_DOMAINS = "domain string, rank int, category string"
FEED_META = "feed_name string, last_synced string, items_count bigint, status string"
PROFILES = (
    "name string, safe_upper double, suspicious_upper double, deceptive_upper double,"
    " phishing_upper double, malware_requires_signal boolean"
)
FEEDBACK = (
    "scan_id string, user_feedback string, classification_at_scan_time string,"
    " risk_score_at_scan_time double, confidence_at_scan_time double, source_type string"
)
HISTORY = (
    "scan_id string, timestamp_millis bigint, source_type string, classification string,"
    " risk_score double, confidence double, recommended_action string, reasons array<string>,"
    " flags array<string>, evidence_keys array<string>, feedback_state string"
)
VERDICT = (
    "struct<scan_id:string,status:string,total_engines:double,completed_engines:double,"
    "skipped_engines:double,risk_score:double,classification:string,"
    "risk_assessment:struct<risk_score:double,classification:string,confidence:double,"
    "contributing_engines:array<string>,ignored_engines:array<string>,flags:array<string>,"
    f"evidence:array<{EVIDENCE}>,reasons:array<string>,recommended_action:string>,"
    "results:array<struct<engine_name:string,risk_score:double,confidence:double,"
    f"flags:array<string>,evidence:array<{EVIDENCE}>,status:string,error_message:string,"
    "metadata:map<string,string>>>,warnings:array<string>>"
)
REDIRECTS = "url string, status int, location string"
REGISTRATIONS = "domain string, created timestamp"
PUBLIC_SUFFIXES = "suffix string"
URL_REPUTATION = "url string, threat_types array<string>, http_status int"
FILE_REPORTS = (
    "sha256 string, malicious bigint, suspicious bigint, undetected bigint, harmless bigint,"
    " http_status int"
)
IMAGE_EXTRACTS = (
    "scan_id string, qr_text string, ocr array<struct<text:string,conf:double>>,"
    " input_fields int, decode_ok boolean, ocr_ok boolean"
)
MAIL_PARTS = (
    "message_id string, headers map<string,string>,"
    " parts array<struct<mime:string,filename:string,attachment_id:string,"
    "headers:map<string,string>,data:string>>"
)
