"""Indicator tables: seeds, feed files, upsert, refresh and statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow import dims
from riskflow.functions.urls import url_host
from riskflow.schemas import ALLOW_DOMAINS, FEED_META, FEED_URLS, HASHES


@dataclass(frozen=True)
class Indicators:
    hashes: DataFrame
    urls: DataFrame
    allow: DataFrame


def seed_hashes(spark: SparkSession, as_of: str) -> DataFrame:
    rows = [(h, s, t, c, v, as_of, src) for h, s, t, c, v, src in dims.SEED_HASHES]
    return spark.createDataFrame(rows, HASHES)


def seed_allow_list(spark: SparkSession) -> DataFrame:
    rows = [(d, i, "top_trusted") for i, d in enumerate(dims.SEED_DOMAINS, start=1)]
    return spark.createDataFrame(rows, ALLOW_DOMAINS)


def seed_indicators(
    spark: SparkSession, as_of: str, stored: Indicators | None = None
) -> Indicators:
    """Stored tables; the hash and allow-list tables are seeded only while empty."""
    if stored is None:
        return Indicators(
            seed_hashes(spark, as_of), spark.createDataFrame([], FEED_URLS), seed_allow_list(spark)
        )
    return Indicators(
        seed_hashes(spark, as_of) if stored.hashes.isEmpty() else stored.hashes,
        stored.urls,
        seed_allow_list(spark) if stored.allow.isEmpty() else stored.allow,
    )


# ------------------------------------------------------------------ feed files
LINE_AT = "struct<file:string,start:bigint,row:bigint>"


def feed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the landed files with their place ``line_at``, which rises in file order.

    A file is read in splits by many tasks. A place is the file, the first byte of the split and the row in
    the task that reads it; places are only compared, so no pass over the file counts its lines.
    """
    return spark.read.text(path).select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("row"),
        ).cast(LINE_AT).alias("line_at"),
        "value",
    )


def _first_lines(lines: DataFrame, keep: Column, limit: int | None) -> DataFrame:
    kept = lines.where(keep)
    return kept.orderBy("line_at").limit(limit) if limit else kept


def _csv_fields(lines: DataFrame, width: int) -> DataFrame:
    names = ", ".join(f"c{i} string" for i in range(width))
    return lines.select(
        "line_at",
        F.from_csv(F.col("value"), F.lit(names), {"mode": "PERMISSIVE", "escape": '"'}).alias("r"),
    ).select("line_at", "r.*")


def read_urlhaus(
    spark: SparkSession, path: str, as_of: str, max_rows: int | None = None
) -> DataFrame:
    """Comma-separated link feed; the cap counts lines before rows are checked."""
    lines = _first_lines(
        feed_lines(spark, path), ~F.col("value").rlike("^(?:#|$)"), max_rows
    )
    rows = _csv_fields(lines, 8).where("c5 is not null")
    url = F.trim("c2")
    return rows.select(
        url.alias("url"),
        url_host(url).alias("domain"),
        F.trim("c5").alias("threat_type"),
        F.coalesce(F.trim("c6"), F.lit("")).alias("tags"),
        F.trim("c3").alias("url_status"),
        F.lit(as_of).alias("first_seen"),
        F.lit("URLhaus").alias("source"),
        "line_at",
    )


def read_malwarebazaar(
    spark: SparkSession, path: str, max_rows: int | None = None
) -> DataFrame:
    lines = _first_lines(
        feed_lines(spark, path), ~F.col("value").rlike("^(?:#|$)"), max_rows
    )
    rows = _csv_fields(lines, 12).where("c10 is not null")
    or_text = lambda c, text: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(text))
    return rows.select(
        F.lower(F.trim("c1")).alias("sha256"),
        or_text("c8", "MalwareSample").alias("signature"),
        F.trim("c6").alias("file_type"),
        or_text("c9", "Detected").alias("clamav"),
        F.coalesce(F.trim("c10").try_cast("double"), F.lit(100.0)).alias("vt_percent"),
        F.trim("c0").alias("first_seen"),
        F.lit("MalwareBazaar").alias("source"),
        "line_at",
    )


def phishing_links(lines: DataFrame, as_of: str, max_rows: int | None = None) -> DataFrame:
    """Rows of a feed of one link a line."""
    url = F.trim("value")
    return _first_lines(lines, url.startswith("http"), max_rows).select(
        url.alias("url"),
        url_host(url).alias("domain"),
        F.lit("phishing").alias("threat_type"),
        F.lit("openphish").alias("tags"),
        F.lit("online").alias("url_status"),
        F.lit(as_of).alias("first_seen"),
        F.lit("OpenPhish").alias("source"),
        "line_at",
    )


def read_openphish(
    spark: SparkSession, path: str, as_of: str, max_rows: int | None = None
) -> DataFrame:
    return phishing_links(feed_lines(spark, path), as_of, max_rows)


# ------------------------------------------------------------------ upsert and statistics
def upsert(stored: DataFrame, loads: list[DataFrame], key: str) -> DataFrame:
    """Last write per key wins: stored rows, then each load in turn, by ``line_at`` inside a load.

    One aggregation with map-side combine; a key repeated very often never gathers.
    """
    fields = stored.columns
    nowhere = F.lit(None).cast(LINE_AT)
    parts = [stored.withColumns({"_load": F.lit(0), "_line": nowhere})]
    for i, load in enumerate(loads, start=1):
        line = F.col("line_at").cast(LINE_AT) if "line_at" in load.columns else nowhere
        parts.append(
            load.withColumns({"_load": F.lit(i), "_line": line}).select(*fields, "_load", "_line")
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return (
        rows.groupBy(key)
        .agg(F.max(F.struct("_load", "_line", *[f for f in fields if f != key])).alias("r"))
        .select(*[F.col(key) if f == key else F.col(f"r.{f}").alias(f) for f in fields])
    )


def manual_url(spark: SparkSession, url: str, as_of: str, threat_type: str = "malware_download",
               tags: str = "", source: str = "Manual") -> DataFrame:
    one = spark.createDataFrame([(url,)], "url string")
    return one.select(
        F.trim("url").alias("url"), url_host(F.trim("url")).alias("domain"),
        F.lit(threat_type).alias("threat_type"), F.lit(tags).alias("tags"),
        F.lit("online").alias("url_status"), F.lit(as_of).alias("first_seen"),
        F.lit(source).alias("source"),
    )


def manual_hash(spark: SparkSession, sha256: str, as_of: str, signature: str = "Generic.Malware",
                file_type: str = "binary", clamav: str = "Threat.Detected",
                vt_percent: float = 100.0, source: str = "Manual") -> DataFrame:
    return spark.createDataFrame(
        [(sha256.strip().lower(), signature, file_type, clamav, vt_percent, as_of, source)], HASHES
    )


def refresh(
    spark: SparkSession,
    stored: Indicators,
    as_of: str,
    urlhaus: str | None = None,
    malwarebazaar: str | None = None,
    openphish: str | None = None,
) -> tuple[Indicators, DataFrame, DataFrame]:
    """Load the landed feed files over the stored tables.

    Returns (new tables, one-row summary, feed_meta row). A feed that cannot be read
    is reported in ``errors`` and leaves its table as it was.
    """
    errors: list[str] = []

    def attempt(name: str, load):
        try:
            frame = load()
            frame.isEmpty()  # a missing or unreadable file fails here, not later
            return frame
        except Exception as exc:  # noqa: BLE001 - one bad feed must not stop the others
            errors.append(f"{name} sync error: {type(exc).__name__}")
            return None

    uh = attempt("URLhaus", lambda: read_urlhaus(spark, urlhaus, as_of)) if urlhaus else None
    mb = attempt("MalwareBazaar", lambda: read_malwarebazaar(spark, malwarebazaar)) if malwarebazaar else None
    op = attempt("OpenPhish", lambda: read_openphish(spark, openphish, as_of)) if openphish else None
    new = Indicators(
        upsert(stored.hashes, [f for f in (mb,) if f is not None], "sha256"),
        upsert(stored.urls, [f for f in (uh, op) if f is not None], "url"),
        stored.allow,
    )
    count = lambda f: F.lit(0).cast("bigint") if f is None else F.lit(f.count())
    status = "partial" if errors else "success"
    urls, hashes = new.urls.count(), new.hashes.count()
    summary = spark.range(1).select(
        F.lit(status).alias("status"),
        count(uh).alias("urlhaus_urls_added"),
        count(mb).alias("malwarebazaar_hashes_added"),
        count(op).alias("openphish_urls_added"),
        F.array(*[F.lit(e) for e in errors]).cast("array<string>").alias("errors"),
        F.lit(as_of).alias("timestamp"),
        F.lit(urls).alias("total_threat_urls"),
        F.lit(hashes).alias("total_malware_hashes"),
    )
    meta = spark.createDataFrame(
        [("threat_feeds_aggregate", as_of, urls + hashes, status)], FEED_META
    )
    return new, summary, meta


def statistics(tables: Indicators, meta: DataFrame | None = None) -> DataFrame:
    """One row: three counts, last sync and status (``baseline``/``ready`` before any sync)."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("what"), "n"
    )
    counts = (
        n(tables.urls, "threat_urls_count")
        .unionByName(n(tables.hashes, "malware_hashes_count"))
        .unionByName(n(tables.allow, "whitelisted_domains_count"))
    )
    pick = lambda name: F.max(F.when(F.col("what") == name, F.col("n"))).alias(name)
    row = counts.agg(
        pick("threat_urls_count"), pick("malware_hashes_count"), pick("whitelisted_domains_count")
    )
    last, state = "baseline", "ready"
    if meta is not None:
        found = meta.where("feed_name = 'threat_feeds_aggregate'").select("last_synced", "status").head()
        if found:
            last, state = found[0], found[1]
    return row.withColumns({"last_synced": F.lit(last), "status": F.lit(state)})


def counts_by_source(urls: DataFrame) -> DataFrame:
    return urls.groupBy("source").agg(F.count(F.lit(1)).alias("added"))
