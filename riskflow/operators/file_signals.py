"""Known-hash and multi-scanner verdicts, and the file-type post rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import dims
from riskflow.functions.columns import (
    engine_result,
    error_result,
    evidence,
    flag,
    keep,
    skipped_result,
    text_of,
)
from riskflow.operators.joins import dim_join
from riskflow.schemas import ENGINE_RESULT


def with_file_report(df: DataFrame, reports: DataFrame | None) -> DataFrame:
    """Add ``file_report`` by content hash; null when the table is absent or silent."""
    if reports is None:
        return df.withColumn(
            "file_report",
            F.lit(None).cast(
                "struct<malicious:bigint,suspicious:bigint,undetected:bigint,harmless:bigint,"
                "http_status:int>"
            ),
        )
    one = reports.groupBy(F.lower("sha256").alias("_rk")).agg(
        F.max(
            F.struct("malicious", "suspicious", "undetected", "harmless", "http_status")
        ).alias("file_report")
    )
    return dim_join(df, one, F.col("sha256") == F.col("_rk")).drop("_rk")


def malware_result(configured: bool) -> Column:
    """Engine result of a row with ``sha256``, ``hash_hit`` and ``file_report``.

    ``configured`` tells whether a report table exists at all.
    """
    hit, report = F.col("hash_hit"), F.col("file_report")
    sig = F.coalesce(hit["signature"], F.lit("MalwarePayload"))
    clam = F.coalesce(hit["clamav"], F.lit("Win.Malware"))
    known = engine_result(
        dims.MALWARE_ENGINE,
        F.lit(100.0),
        1.0,
        F.array(
            F.lit("MALWARE"), F.lit("malware_detected"), F.lit("malwarebazaar_verified"),
            F.concat(F.lit("threat_family:"), sig),
        ),
        F.array(
            evidence(
                "MALWARE_SIGNATURE",
                F.to_json(
                    F.struct(
                        F.col("sha256"),
                        sig.alias("signature"),
                        clam.alias("clamav"),
                        text_of(F.coalesce(hit["vt_percent"], F.lit(100.0)), "%").alias(
                            "detection_rate"
                        ),
                        F.coalesce(hit["source"], F.lit("MalwareBazaar")).alias("source"),
                    )
                ),
                text_of("Verified malware payload matched in global threat intelligence: ",
                        sig, " (", clam, ")"),
            )
        ),
    )
    bad, odd = F.coalesce(report["malicious"], F.lit(0)), F.coalesce(report["suspicious"], F.lit(0))
    total = bad + odd + F.coalesce(report["undetected"], F.lit(0)) + F.coalesce(
        report["harmless"], F.lit(0)
    )
    scanned = engine_result(
        dims.MALWARE_ENGINE,
        F.when(total > 0, (bad + odd) / total).otherwise(0.0) * 100.0,
        0.9,
        keep(flag("vt_malicious", bad > 0), flag("vt_suspicious", odd > 0)),
    )
    if not configured:
        missing = error_result(dims.MALWARE_ENGINE, "VIRUSTOTAL_API_KEY_NOT_CONFIGURED")
    else:
        # a file no scanner has seen counts as a failed look-up
        missing = error_result(dims.MALWARE_ENGINE, "file report not found")
    failed = error_result(
        dims.MALWARE_ENGINE, text_of("VT_API_ERROR_", report["http_status"])
    )
    return (
        F.when(
            F.col("sha256").isNull(),
            skipped_result(dims.MALWARE_ENGINE, "No file bytes provided"),
        )
        .when(hit.isNotNull(), known)
        .when(report.isNull() | (report["http_status"] == 404), missing)
        .when(report["http_status"] == 200, scanned)
        .otherwise(failed)
    )


def apply_extension_mismatch(results: Column, mismatch: Column) -> Column:
    """Mark both file engines of a mismatched file; the malware score gains 30."""
    name = "extension_mismatch"

    def marked(r: Column) -> Column:
        target = r["engine_name"].isin(dims.MALWARE_ENGINE, dims.ATTACHMENT_ENGINE) & (
            r["status"] != "skipped"
        )
        flags = F.when(F.array_contains(r["flags"], name), r["flags"]).otherwise(
            F.array_append(r["flags"], F.lit(name))
        )
        score = F.when(
            r["engine_name"] == dims.MALWARE_ENGINE,
            F.least(r["risk_score"] + 30.0, F.lit(100.0)),
        ).otherwise(r["risk_score"])
        changed = r.withField("flags", flags).withField("risk_score", score)
        return F.when(target, changed.cast(ENGINE_RESULT)).otherwise(r.cast(ENGINE_RESULT))

    return F.when(mismatch, F.transform(results, marked)).otherwise(results)
