"""Live flows: link watch, inbox check, alert sinks, feed refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.functions.columns import no_flags
from riskflow.functions.text import mostly_redacted, redact, suspicious_snippet
from riskflow.functions.urls import extract_screen_urls
from riskflow.operators.dedup import pending
from riskflow.operators.joins import keep_rows
from riskflow.operators.triage import triage
from riskflow.operators.watch import failures, watch_gate
from riskflow.operators.sender_rules import SenderState
from riskflow.plans.scan import scan, senders_after
from riskflow.sources import feeds
from riskflow.sources.history import history_records, new_records
from riskflow.sources.mail import mail_to_scans
from riskflow.sources.snapshots import open_snapshot, publish, retain, versions
from riskflow.schemas import HISTORY
from riskflow.streaming.state import WatchGate, keyed


def is_watch_alert() -> Column:
    return F.col("classification") != "Safe"


def is_inbox_alert() -> Column:
    return F.col("classification").isin("Phishing", "Malware")


def watch_alerts(verdicts: DataFrame) -> DataFrame:
    return keep_rows(verdicts, is_watch_alert())


def inbox_alerts(verdicts: DataFrame) -> DataFrame:
    return keep_rows(verdicts, is_inbox_alert())


def watch_targets(screens: DataFrame) -> DataFrame:
    """Links of visible text, else its redacted suspicious snippet.

    Reads ``device_id, arrival_seq, t_us, text``; one row per target with
    ``position`` inside the screen, ``watch_key``, ``url`` and ``text``. A snippet that is mostly redacted is dropped.
    """
    df = screens.withColumns(
        {
            "_urls": extract_screen_urls(F.col("text")),
            "_snip": suspicious_snippet(F.col("text")),
        }
    )
    df = df.withColumn("_safe", redact(F.col("_snip")))
    df = df.withColumns(
        {
            "_urls": F.coalesce("_urls", no_flags()),
            "_note": (F.size("_urls") == 0)
            & F.col("_snip").isNotNull()
            & ~mostly_redacted(F.col("_snip"), F.col("_safe")),
        }
    )
    link = F.transform(
        "_urls",
        lambda u, i: F.struct(
            u.alias("watch_key"), u.alias("url"), F.lit(None).cast("string").alias("text"),
            i.alias("position"),
        ),
    )
    note = F.array(
        F.struct(
            F.concat(F.lit("text:"), F.xxhash64("_safe").cast("string")).alias("watch_key"),
            F.lit(None).cast("string").alias("url"),
            F.col("_safe").alias("text"),
            F.lit(0).alias("position"),
        )
    )
    targets = F.when(F.col("_note"), note).otherwise(link)
    return df.select("device_id", "arrival_seq", "t_us", F.explode(targets).alias("x")).select(
        "device_id", "arrival_seq", "x.position", "t_us", "x.watch_key", "x.url", "x.text",
    )


def _watch_events(screens: DataFrame, failed: DataFrame | None) -> DataFrame:
    targets = watch_targets(screens).withColumn("failed", F.lit(False))
    if failed is None:
        return targets
    return targets.unionByName(failures(failed), allowMissingColumns=True)


def link_watch_rows(screens: DataFrame, failed: DataFrame | None = None, **limits) -> DataFrame:
    """Targets of a table of visible texts with ``accepted``; ``failed`` as in :func:`link_watch`."""
    gated = watch_gate(_watch_events(screens, failed), **limits)
    return gated.where("not failed").drop("failed")


def link_watch(screens: DataFrame, failed: DataFrame | None = None, **limits) -> DataFrame:
    """Accepted targets of a stream of visible texts with their triage verdict.

    ``failed``: stream of failed scans (``device_id, arrival_seq, position, t_us, watch_key`` of
    the target, ``t_us`` being the time of the failure), whose marks are taken back.
    """
    gated = keyed(
        _watch_events(screens, failed), ["device_id"], WatchGate(**limits),
        "accepted boolean",
    )
    return triage(gated.where("accepted").drop("failed"))


# ------------------------------------------------------------------ sinks
def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink that a repeated batch overwrites instead of doubling."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_other_batches(spark: SparkSession, path: str, ddl: str, batch_id: int) -> DataFrame:
    """Rows written by other batches; a repeated batch must not see its own first try."""
    try:
        found = spark.read.schema(ddl + ", batch int").parquet(path)
    except AnalysisException:  # nothing written yet
        return spark.createDataFrame([], ddl)
    return found.where(F.col("batch") != batch_id).drop("batch")


def scan_uuid(message_id: str) -> Column:
    """Scan id of a mail in the form of a UUID, made from the hash of its id."""
    h = F.sha2(F.col(message_id), 256)
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(
        part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-a"), part(18, 3),
        F.lit("-"), part(21, 12),
    )


#: rows of the folder ``failed`` that :func:`link_watch_batch` writes and :func:`link_watch` reads
FAILED = "device_id string, arrival_seq bigint, position int, t_us bigint, watch_key string"


def failed_scans(spark: SparkSession, root: str) -> DataFrame:
    """Stream of the failures written below ``root``. A batch that is written again may
    report one twice, which changes nothing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/failed")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return spark.readStream.schema(FAILED).option("recursiveFileLookup", True).parquet(f"{root}/failed")


def link_watch_batch(
    tables: feeds.Indicators, root: str, delay_us: int = 0, **scan_options
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body behind :func:`link_watch`: full verdicts of the accepted targets.

    Four tables are written per batch and overwritten when it runs again: ``instant`` (alerts of the
    triage verdict), ``alerts`` (any class but Safe of the full verdict), ``history`` and ``failed``: targets
    without a verdict, whose marks :func:`failed_scans` hands back to the gate, ``delay_us`` after they were seen.
    """

    def run(targets: DataFrame, batch_id: int) -> None:
        put = lambda df, name: batch_writer(f"{root}/{name}")(df, batch_id)
        spark = targets.sparkSession
        # the id of a target is its place, so a repeated batch gives the same ids
        place = F.concat_ws("|", "device_id", "arrival_seq", "position")
        targets = targets.withColumn("_place", place).withColumn("_scan", scan_uuid("_place")).drop("_place").persist()
        try:
            put(
                watch_alerts(targets).select("device_id", "watch_key", F.col("_scan").alias("scan_id"), "classification"),
                "instant",
            )
            requests = targets.select(
                F.col("_scan").alias("scan_id"), "arrival_seq", F.col("device_id").alias("client_id"), "url", "text",
                F.timestamp_micros("t_us").alias("ts"), F.lit("guardian").alias("source_channel"),
            )
            verdicts, _ = scan(requests, tables, **scan_options)
            verdicts = verdicts.persist()
            try:
                stored = read_other_batches(spark, f"{root}/history", HISTORY, batch_id)
                records = history_records(verdicts, F.lit("accessibility_guard"), F.unix_millis("ts"))
                put(new_records(records, stored), "history")
                put(
                    watch_alerts(verdicts).select("scan_id", "classification", "risk_score", "recommended_action"),
                    "alerts",
                )
                scored = verdicts.select(F.col("scan_id").alias("_scan"))
                lost = targets.join(scored, "_scan", "left_anti").withColumn("t_us", F.col("t_us") + delay_us)
                put(lost.selectExpr("device_id", "arrival_seq", "position", "t_us", "watch_key"), "failed")
            finally:
                verdicts.unpersist()
        finally:
            targets.unpersist()

    return run


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete versions of the sender state below ``root``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    # a version counts once its second table is complete
    done = [p for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "names/_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def stored_senders(spark: SparkSession, root: str, before: int | None = None) -> SenderState | None:
    """Latest sender state below ``root``, of a batch before ``before`` if given."""
    known = [v for v in _versions(spark, root) if before is None or v < before]
    if not known:
        return None
    return SenderState(*(spark.read.parquet(f"{root}/batch={known[-1]}/{t}") for t in ("profiles", "names")))


def store_senders(state: SenderState, root: str, batch_id: int, keep: int = 2) -> None:
    """Write a version of the sender state; only the last ``keep`` before it stay."""
    spark = state.profiles.sparkSession
    for name, table in (("profiles", state.profiles), ("names", state.names)):
        table.write.mode("overwrite").parquet(f"{root}/batch={batch_id}/{name}")
    for old in [v for v in _versions(spark, root) if v < batch_id][:-keep]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/batch={old}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def inbox_batch(tables: feeds.Indicators, root: str, as_scan_id=None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body of the inbox check.

    Pending mails are scanned; history and alerts are written; only mails that got a
    verdict are marked as processed, so a failed or rejected one is taken up again. Sender
    profiles of earlier batches are taken on and written anew.
    ``as_scan_id``: scan id as a Column over the mail rows; a UUID of the mail id by default.
    """

    def run(mails: DataFrame, batch_id: int) -> None:
        spark = mails.sparkSession
        done = read_other_batches(spark, f"{root}/processed", "message_id string", batch_id)
        fresh = pending(mails.dropDuplicates(["message_id"]), done)
        rows = mail_to_scans(fresh).withColumn("_mail", F.col("scan_id"))
        rows = rows.withColumn("scan_id", scan_uuid("_mail") if as_scan_id is None else as_scan_id)
        senders = stored_senders(spark, f"{root}/senders", batch_id)
        verdicts, _ = scan(rows.drop("_mail"), tables, senders=senders)
        verdicts = verdicts.persist()
        try:
            stored = read_other_batches(spark, f"{root}/history", HISTORY, batch_id)
            records = history_records(verdicts, F.lit("gmail"), F.unix_millis("ts"))
            put = lambda df, name: batch_writer(f"{root}/{name}")(df, batch_id)
            put(new_records(records, stored), "history")
            put(
                inbox_alerts(verdicts).select(
                    "scan_id", "classification", "risk_score", "recommended_action"
                ),
                "alerts",
            )
            scored = rows.join(verdicts.select("scan_id"), "scan_id", "left_semi")
            store_senders(senders_after(scored.drop("_mail"), senders), f"{root}/senders", batch_id)
            put(scored.select(F.col("_mail").alias("message_id")).distinct(), "processed")
        finally:
            verdicts.unpersist()

    return run


def stored_indicators(spark: SparkSession, root: str, as_of: str, version: int | None = None) -> feeds.Indicators:
    """Indicator tables of one published version (the latest by default); the seeds before there is any."""
    found = open_snapshot(spark, root, version)
    if found is None:
        return feeds.seed_indicators(spark, as_of)
    return feeds.Indicators(found.read("hashes"), found.read("urls"), found.read("allow"))


def refresh_snapshot(
    spark: SparkSession, stored: feeds.Indicators, as_of: str, out: str, keep: int = 2, **files
) -> feeds.Indicators:
    """Scheduled feed refresh: load the landed files and publish a new version below ``out``.

    A refresh that fails on the way leaves the version before it in force.
    """
    new, summary, meta = feeds.refresh(spark, stored, as_of, **files)
    tables = {"hashes": new.hashes, "urls": new.urls, "allow": new.allow, "summary": summary, "meta": meta}
    made = publish(spark, out, tables, {"as_of": as_of})
    retain(spark, out, keep)
    return feeds.Indicators(made.read("hashes"), made.read("urls"), made.read("allow"))


def landed_links(spark: SparkSession, folder: str, archive: str | None = None) -> DataFrame:
    """Stream of the lines of link feed files that land in ``folder``; ``archive`` takes the files that are done."""
    lines = spark.readStream.option("maxFilesPerTrigger", 100)
    if archive is not None:
        lines = lines.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    # a file that lands later is newer, whatever its name
    return lines.text(folder).select(
        "value", F.col("_metadata.file_modification_time").alias("landed"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )


def feed_batch(root: str, as_of: str, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body behind :func:`landed_links`: upsert into the latest version, published per batch.

    A repeated batch finds its version published and changes nothing. Of equal links in a batch the one landed
    last wins, inside a file the later line.
    """

    def run(lines: DataFrame, batch_id: int) -> None:
        spark = lines.sparkSession
        if batch_id in versions(spark, root):
            return
        stored = stored_indicators(spark, root, as_of)
        stamp = F.concat_ws(" ", F.date_format("landed", "yyyy-MM-dd HH:mm:ss.SSS"), "file")
        place = F.struct(stamp.alias("file"), "start", F.monotonically_increasing_id().alias("row"))
        load = feeds.phishing_links(lines.select(place.cast(feeds.LINE_AT).alias("line_at"), "value"), as_of)
        urls = feeds.upsert(stored.urls, [load], "url")
        publish(spark, root, {"hashes": stored.hashes, "urls": urls, "allow": stored.allow}, {"as_of": as_of}, batch_id)
        retain(spark, root, keep)

    return run
