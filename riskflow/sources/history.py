"""Scan history: sanitized records, first-wins sink, pages, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import dims
from riskflow.functions.text import redact, safe_key
from riskflow.operators.joins import dim_join, keep_rows


def history_records(
    verdicts: DataFrame,
    source_type: Column,
    timestamp_millis: Column,
    max_reasons: int | None = None,
    max_keys: int | None = None,
) -> DataFrame:
    """Sanitized history rows of verdicts; rows that break a rule are left out.

    All reasons, flags and evidence keys are kept unless a bound is given.
    """
    core = F.regexp_replace("scan_id", "^(?:local-)?(?:demo-)?", "")
    valid = (
        core.rlike(dims.UUID_PATTERN)
        & F.col("classification").isin(dims.CLASSES)
        & F.col("risk_score").between(0.0, 100.0)
        & ~F.isnan("risk_score")
        & F.col("confidence").between(0.0, 1.0)
        & ~F.isnan("confidence")
    )

    def tidy(items: Column, most: int | None) -> Column:
        own = F.array_distinct(F.filter(items, lambda x: F.trim(x) != ""))
        return F.slice(own, 1, most) if most else own

    source = F.lower(source_type)
    return keep_rows(verdicts, valid).select(
        "scan_id",
        timestamp_millis.cast("bigint").alias("timestamp_millis"),
        F.when(source.isin(dims.HISTORY_SOURCES), source).otherwise("unknown").alias("source_type"),
        "classification",
        "risk_score",
        "confidence",
        redact(F.col("recommended_action")).alias("recommended_action"),
        tidy(F.transform("reasons", lambda r: redact(r)), max_reasons).alias("reasons"),
        tidy(F.transform("flags", lambda f: safe_key(f)), max_keys).alias("flags"),
        tidy(F.transform("evidence", lambda e: safe_key(e["key"])), max_keys).alias(
            "evidence_keys"
        ),
        F.lit(None).cast("string").alias("feedback_state"),
    )


def new_records(records: DataFrame, stored: DataFrame) -> DataFrame:
    """Records whose scan is not stored yet, earliest first-seen row per scan."""
    rest = [c for c in records.columns if c not in ("scan_id", "timestamp_millis")]
    first = (
        records.groupBy("scan_id")
        .agg(F.min(F.struct("timestamp_millis", *rest)).alias("r"))
        .select("scan_id", "r.*")
        .select(*records.columns)
    )
    return first.join(stored.select("scan_id"), "scan_id", "left_anti")


def history_page(
    history: DataFrame,
    limit: int = 25,
    offset: int = 0,
    classification: str | None = None,
    source_type: str | None = None,
) -> DataFrame:
    """One page of ``limit`` rows, newest first; unknown filter values are ignored."""
    if classification in dims.CLASSES:
        history = history.where(F.col("classification") == classification)
    if source_type and source_type.lower() in dims.HISTORY_SOURCES:
        history = history.where(F.col("source_type") == source_type.lower())
    return (
        history.orderBy(F.desc("timestamp_millis"), F.desc("scan_id"))
        .offset(max(offset, 0))
        .limit(max(limit, 1))
    )


def history_row(history: DataFrame, scan_id: str) -> DataFrame:
    return history.where(F.col("scan_id") == scan_id).limit(1)


def delete_scans(history: DataFrame, scan_ids: DataFrame) -> DataFrame:
    return history.join(scan_ids.select("scan_id"), "scan_id", "left_anti")


def delete_all(history: DataFrame) -> DataFrame:
    return history.where(F.lit(False))


def update_feedback(history: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply ``updates(scan_id, feedback_state)``; other states than the two votes are ignored."""
    good = (
        updates.where(F.col("feedback_state").isin("positive", "negative"))
        .groupBy("scan_id")
        .agg(F.max("feedback_state").alias("_new"))
    )
    return (
        dim_join(history, good, "scan_id")
        .withColumn("feedback_state", F.coalesce("_new", "feedback_state"))
        .drop("_new")
    )
