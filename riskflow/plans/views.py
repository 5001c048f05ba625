"""Message, link, mail and vote tables derived from the given tables.

Each entry is the SELECT list and the table it reads; the text is valid in Spark SQL
and in DuckDB, so both sides of a comparison start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.session import spread

SCAN_URLS = ("pages", {
    "page_id": "page_id",
    "url": """CASE page_id % 10
      WHEN 0 THEN concat('http://10.0.', page_id % 256, '.7/login')
      WHEN 1 THEN replace(url, '://', '://user@')
      WHEN 2 THEN replace(replace(replace(url, 'example.com', 'example.xyz'), 'example.org', 'example.xyz'), 'example.net', 'example.xyz')
      WHEN 3 THEN concat(url, '/', repeat('a', 80))
      WHEN 4 THEN replace(url, '://', '://a-b-c-d.')
      WHEN 5 THEN concat('https://host', page_id, '.example.com:8443//verify?x=1&y=2&z=3&k=%20_')
      WHEN 6 THEN concat('https://b64.example.com/?q=', repeat('Ab1', 12))
      WHEN 7 THEN concat('https://accounts.google.com/p/', page_id)
      WHEN 8 THEN concat('https://bit.ly/', page_id)
      ELSE url END""",
})

RAW_URLS = ("pages", {
    "page_id": "page_id",
    "url": """CASE page_id % 12
      WHEN 0 THEN concat('<', url, '>')
      WHEN 1 THEN concat('  HTTPS://EXAMPLE.Com:443/', page_id, '?A=b#C ')
      WHEN 2 THEN concat('javascript:alert(', page_id, ')')
      WHEN 3 THEN concat('"', url, '"')
      WHEN 4 THEN concat('ftp://files.example.com/', page_id)
      WHEN 5 THEN concat('host', page_id, '.example.net/path')
      WHEN 6 THEN concat('http://u:p@Host.example.com:8080/', page_id)
      WHEN 7 THEN concat('http://example.com:80/', page_id, ';v=1')
      WHEN 8 THEN 'http:///nohost'
      WHEN 9 THEN concat('http://example.com:99', page_id, '99/')
      WHEN 10 THEN concat(url, '/', repeat('a', 4100))
      ELSE url END""",
})

TEXT = ("documents", {
    "doc_id": "doc_id",
    "text": """concat(text, CASE doc_id % 9
      WHEN 0 THEN ' URGENT act now within 24 hours'
      WHEN 1 THEN ' verify your account password'
      WHEN 2 THEN ' your account was suspended'
      WHEN 3 THEN ' winner, claim your prize'
      WHEN 4 THEN ' pay by gift card or wire transfer'
      WHEN 5 THEN ' never share your otp with anyone'
      WHEN 6 THEN ' URGENT verify your identity, account locked, send bitcoin, lottery winner'
      ELSE '' END)""",
})

LINK_TEXT = ("documents", {
    "doc_id": "doc_id",
    "text": """concat(text, CASE doc_id % 6
      WHEN 0 THEN concat(' see (https://a.example.com/x', doc_id, '), then http://b.example.org/y!')
      WHEN 1 THEN concat(' www.shop.example.net/', doc_id, ' and pay.example.xyz/in.')
      WHEN 2 THEN ' reply to help.desk@example.com or call +1 (555) 123-4567'
      WHEN 3 THEN ' password: hunter2, code 123456'
      WHEN 4 THEN ' token abcdefghijklmnopqrstuvwxyz0123456789 end'
      ELSE ' twice https://a.example.com/z https://a.example.com/z' END)""",
})

SCREEN = ("conversations", {
    "conv_id": "conv_id",
    "turn": "turn",
    "text": """concat(text, CASE (conv_id + turn) % 4
      WHEN 0 THEN ' Security alert: unusual activity'
      WHEN 1 THEN ' password reset'
      ELSE '' END)""",
})

MESSAGES = ("events", {
    "arrival_seq": "event_id",
    "ts": "ts",
    "client_id": "concat('c', user_id % 5)",
    "sender_raw": "concat('User ', user_id % 40, ' <u', user_id, '@mail.example.com>')",
    "sender_domain": "CASE WHEN event_id % 97 = 0 THEN 'evil.example.net' ELSE concat('d', user_id % 3, '.example.com') END",
    "has_link": "event_type = 'click'",
    "has_file": "event_type = 'purchase' AND value > 20",
})

WATCH_SCREENS = ("events", {
    "arrival_seq": "event_id",
    "ts": "ts",
    "device_id": "concat('d', user_id % 10)",
    "text": """CASE WHEN event_id % 9 = 4 THEN 'Security alert: unusual activity' WHEN event_id % 9 = 5 THEN 'nothing here'
      WHEN event_id % 9 = 6 THEN concat('open https://two.example.com/', user_id % 3, ' or https://', event_type, '.example.com/ now')
      ELSE concat('open https://', event_type, '.example.com/ now') END""",
})

HEADERS = ("events", {
    "scan_id": "event_id",
    "h_from": "concat('u', user_id, '@d', user_id % 3, '.example.com')",
    "h_reply_to": """CASE event_id % 5 WHEN 0 THEN 'help@other.example.net'
      WHEN 1 THEN concat('x', user_id, '@d', user_id % 3, '.example.com') END""",
    "h_return_path": "CASE event_id % 7 WHEN 0 THEN '<bounce@other.example.net>' END",
    "h_message_id": """CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN '<1@other.example.net>'
      ELSE concat('<', event_id, '@d', user_id % 3, '.example.com>') END""",
    "h_date": "CAST(NULL AS STRING)",
    "h_spf": "CASE event_id % 13 WHEN 0 THEN 'fail' WHEN 1 THEN 'softfail' ELSE 'pass' END",
    "h_dkim": "CAST(NULL AS STRING)",
    "h_dmarc": "CAST(NULL AS STRING)",
    "h_auth": "CASE event_id % 17 WHEN 0 THEN 'dkim=fail dmarc=pass' END",
    "h_received": "CASE event_id % 19 WHEN 0 THEN 'from forged.host' ELSE 'from mx.example.com' END",
})



def page_addresses(hex_int) -> str:
    """Address texts of both families made from a digest of each URL, as a SELECT over ``pages``.

    ``hex_int(e)``: SQL of the number that hex text ``e`` stands for.
    """
    octets = ", '.', ".join(hex_int(f"substr(h, {i}, 2)") for i in (9, 11, 13, 15))
    groups = "substr(h, 1, 4), ':', substr(h, 5, 4), '::', substr(h, 9, 4), ':', substr(h, 13, 4)"
    return f"""SELECT page_id, h, CASE WHEN substr(h, 32, 1) = '0' THEN concat('x', h) WHEN substr(h, 32, 1) < '8' THEN concat({octets})
  WHEN substr(h, 32, 1) = '8' THEN upper(concat({groups})) WHEN substr(h, 32, 1) < 'd' THEN concat({groups})
  ELSE concat({groups.replace("substr(h, 1, 4)", "'2001'").replace("substr(h, 5, 4)", "concat('0', substr(h, 6, 3))")}) END AS address
FROM (SELECT page_id, md5(url) AS h FROM pages)"""


#: every twentieth page gives a block
BLOCK_BITS = """CASE WHEN address LIKE '%:%' THEN CASE substr(h, 31, 1) WHEN '0' THEN 0 WHEN '1' THEN 18 WHEN '2' THEN 23 ELSE 2 END
  ELSE CASE substr(h, 31, 1) WHEN '0' THEN 0 WHEN '1' THEN 16 WHEN '2' THEN 7 ELSE 3 END END"""

HISTORY = ("events", {
    "scan_id": "concat('00000000-0000-4000-8000-', lpad(cast(event_id AS STRING), 12, '0'))",
    "ts": "ts",
    "source_type": """CASE event_type WHEN 'click' THEN 'url' WHEN 'view' THEN 'gmail'
      WHEN 'error' THEN 'share' WHEN 'signup' THEN 'demo' ELSE 'file' END""",
    "classification": """CASE WHEN value < 5 THEN 'Safe' WHEN value < 15 THEN 'Suspicious'
      WHEN value < 30 THEN 'Deceptive' WHEN value < 60 THEN 'Phishing' ELSE 'Malware' END""",
    "risk_score": "least(value, 100.0)",
})

FILES = ("documents", {
    "doc_id": "doc_id",
    "att_name": """CASE doc_id % 16
      WHEN 0 THEN concat('report', doc_id, '.pdf')
      WHEN 1 THEN concat('invoice', doc_id, '.pdf.exe')
      WHEN 2 THEN concat('dir/sub/notes', doc_id, '.txt')
      WHEN 3 THEN concat('payment', doc_id, '.js')
      WHEN 4 THEN concat('sheet', doc_id, '.xlsm')
      WHEN 5 THEN concat('photo', doc_id, '.jpg')
      WHEN 6 THEN concat('page', doc_id, '.html')
      WHEN 7 THEN concat('memo', doc_id, '.rtf')
      WHEN 8 THEN concat('readme', doc_id)
      WHEN 9 THEN concat('list___', doc_id, '.scr')
      WHEN 10 THEN concat('data', doc_id, '.csv')
      WHEN 11 THEN concat('tool', doc_id, '.sh')
      WHEN 12 THEN concat('old', doc_id, '.doc.iso')
      WHEN 13 THEN concat('setup', doc_id, '.msi')
      WHEN 14 THEN concat('bank', doc_id, '.pdf')
      ELSE concat('letter', doc_id, '.docx') END""",
    "body": """concat(CASE doc_id % 16
      WHEN 0 THEN '%PDF-1.4 ' WHEN 1 THEN 'MZ' WHEN 5 THEN 'MZ'
      WHEN 6 THEN '<html><script>x</script>' WHEN 7 THEN '{\\\\rtf1 \\\\objdata '
      WHEN 11 THEN '#!/bin/sh ' WHEN 14 THEN '%PDF-1.7 /JavaScript '
      ELSE '' END, text)""",
})

# every line of a document is an entry; its digest decides what kind
ENTRY_NAME = """concat(CASE substr(h, 2, 1) WHEN '0' THEN '../' WHEN '1' THEN 'a/b/c/d/e/' WHEN '2' THEN 'dir\\\\' ELSE '' END, 'f', substr(h, 8, 5),
  CASE substr(h, 1, 1) WHEN '0' THEN '.pdf.exe' WHEN '1' THEN '.sh' WHEN '2' THEN '.zip' WHEN '3' THEN '.zip' WHEN '4' THEN '.JS'
  WHEN '5' THEN '.tar' WHEN '6' THEN '.dll' WHEN '7' THEN '' WHEN '8' THEN '.doc.iso' ELSE '.txt' END)"""
ENTRY_COLUMNS_SPARK = [
    "doc_id AS file_id", "pos AS entry_id",
    "CASE WHEN substr(before, 1, 1) IN ('2', '3') AND substr(h, 3, 1) < '8' THEN pos - 1 END AS parent_id",
    "CASE WHEN doc_id % 3 = 0 THEN 'tar' ELSE 'zip' END AS kind", f"{ENTRY_NAME} AS name",
    "cast(n * 1000 AS bigint) AS size", "cast(CASE WHEN substr(h, 4, 1) = '0' THEN n ELSE n * 15 END AS bigint) AS packed",
    "substr(h, 5, 1) = '0' AS is_dir", "substr(h, 6, 1) = '0' AS encrypted",
]
ENTRIES_SQL = f"""SELECT {", ".join(ENTRY_COLUMNS_SPARK)} FROM (SELECT *, lag(h) OVER (PARTITION BY doc_id ORDER BY pos) AS before
  FROM (SELECT doc_id, pos, md5(l[pos + 1]) AS h, length(l[pos + 1]) AS n
    FROM (SELECT doc_id, l, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))))""".replace("\\\\", "\\")

_FEEDBACK = {
    "arrival_seq": "d.doc_id + r.k * 1000000",
    "scan_id": "concat('00000000-0000-4000-8000-', lpad(cast(d.doc_id AS STRING), 12, '0'))",
    "user_feedback": """CASE WHEN l.quality IS NULL THEN NULL
      WHEN (l.quality + r.k) % 2 = 1 THEN 'positive' ELSE 'negative' END""",
    "classification_at_scan_time": """CASE WHEN n_chars < 300 THEN 'Safe' WHEN n_chars < 600 THEN 'Suspicious'
      WHEN n_chars < 1200 THEN 'Deceptive' WHEN n_chars < 3000 THEN 'Phishing' ELSE 'Malware' END""",
    "risk_score_at_scan_time": "cast(n_chars % 101 AS DOUBLE)",
    "confidence_at_scan_time": "cast(0.5 AS DOUBLE)",
    "source_type": """CASE d.doc_id % 6 WHEN 0 THEN 'url' WHEN 1 THEN 'file' WHEN 2 THEN 'share'
      WHEN 3 THEN 'gmail' WHEN 4 THEN 'sms' END""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # long texts and pages cost far more to score than to move
    return spread(df) if name in ("documents", "pages", "conversations") else df


def view(spark: SparkSession, sf_dir: str, spec) -> DataFrame:
    source, columns = spec
    return table(spark, sf_dir, source).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def view_sql(spec) -> str:
    source, columns = spec
    items = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    return f"SELECT {items} FROM {source}".replace("\\\\", "\\")


def feed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "pages")
        .where("page_id % 25 = 9")
        .groupBy("url")
        .agg(F.min(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("domain"))
        .selectExpr(
            "url", "domain", "'malware_download' AS threat_type", "'' AS tags",
            "'online' AS url_status", "'2024-01-01' AS first_seen", "'URLhaus' AS source",
        )
    )


#: a comment, a short line, or a link that others repeat; the last line of a link wins
FEED_LINE = '''CASE WHEN page_id % 7 = 3 THEN '# comment' WHEN page_id % 11 = 5 THEN concat('"', page_id, '","short"')
  ELSE concat('"', page_id, '","2024-01-01"," https://feed.example.com/', page_id % 40, substr(md5(url), 1, 1), ' ","online","l","t', page_id,
    '","one,""two""","u","r"') END'''

FEED_URLS_SQL = """SELECT url, min(regexp_extract(url, '://([^/?#]*)', 1)) AS domain,
  'malware_download' AS threat_type, '' AS tags, 'URLhaus' AS source
  FROM pages WHERE page_id % 25 = 9 GROUP BY url"""


def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").selectExpr("doc_id", "posexplode(split(text, '\n')) AS (pos, line)")
    hashed = lines.selectExpr("doc_id", "pos", "md5(line) AS h", "length(line) AS n").selectExpr(
        "*", "lag(h) OVER (PARTITION BY doc_id ORDER BY pos) AS before"
    )
    return hashed.selectExpr(*ENTRY_COLUMNS_SPARK)


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").alias("d")
    labels = table(spark, sf_dir, "labels").alias("l")
    # a second vote for every seventh scan
    rounds = F.when(F.col("d.doc_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    joined = docs.join(labels, F.col("d.doc_id") == F.col("l.doc_id"), "left").select(
        "d.doc_id", "d.n_chars", "l.quality", F.explode(rounds).alias("k")
    )
    strip = lambda e: e.replace("d.", "").replace("r.k", "k").replace("l.quality", "quality")
    return joined.selectExpr(*[f"{strip(e)} AS {n}" for n, e in _FEEDBACK.items()])


FEEDBACK_SQL = (
    "SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in _FEEDBACK.items())
    + """ FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) r ON r.k = 0 OR d.doc_id % 7 = 0"""
)

# time since 2024 divided by 96, so that sender and repeat rules meet dense traffic
EPOCH_2024 = 1_704_067_200_000_000
T_US_SPARK = f"(unix_micros(cast(ts AS TIMESTAMP)) - {EPOCH_2024}) div 96"
T_US_SQL = f"(epoch_us(ts) - {EPOCH_2024}) // 96"
T1_SPARK = f"unix_micros(cast(ts AS TIMESTAMP)) - {EPOCH_2024}"
T1_SQL = f"epoch_us(ts) - {EPOCH_2024}"


def messages(spark: SparkSession, sf_dir: str, compressed: bool = True) -> DataFrame:
    return view(spark, sf_dir, MESSAGES).withColumn(
        "t_us", F.expr(T_US_SPARK if compressed else T1_SPARK)
    )


def messages_sql(compressed: bool = True) -> str:
    return f"SELECT *, {T_US_SQL if compressed else T1_SQL} AS t_us FROM ({view_sql(MESSAGES)})"
