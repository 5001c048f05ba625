"""Reasons and recommended action of an assessment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import dims
from riskflow.functions.columns import lookup, no_flags


def flag_reason(flag: Column) -> Column:
    return (
        F.when(
            flag.startswith("nlp_"),
            F.concat(
                F.lit("Natural language processing found signs of "),
                F.replace(F.replace(flag, F.lit("nlp_"), F.lit("")), F.lit("_"), F.lit(" ")),
                F.lit("."),
            ),
        )
        .when(flag.startswith("high_hyphen_count"), F.lit(dims.REASON_HYPHENS))
        .when(
            flag.startswith("threat_family:"),
            F.concat(
                F.lit("Confirmed malware payload belonging to the "),
                F.replace(flag, F.lit("threat_family:"), F.lit("")),
                F.lit(" family."),
            ),
        )
        .otherwise(lookup(flag, dims.FLAG_REASONS))
    )


def _evidence_reason(e: Column) -> Column:
    spaced = F.replace(e["key"], F.lit("_"), F.lit(" "))
    readable = F.concat(
        F.upper(F.substring(spaced, 1, 1)), F.lower(F.substring(spaced, F.lit(2), F.length(spaced)))
    )
    return F.when(F.length(e["description"]) > 0, e["description"]).otherwise(
        F.concat(
            F.lit("Evidence found - "),
            readable,
            F.lit(": "),
            F.coalesce(e["value"], F.lit("None")),
            F.lit("."),
        )
    )


def explain(df: DataFrame) -> DataFrame:
    """Add ``reasons`` and ``recommended_action`` to fused and classified rows."""
    df = df.withColumn(
        "_x",
        F.array_distinct(
            F.concat(
                F.array_compact(F.transform("flags", flag_reason)),
                F.transform("evidence", _evidence_reason),
                F.col("warnings"),
            )
        ),
    )
    no_malware_scan = F.array_contains("ignored_engines", dims.MALWARE_ENGINE)
    mentioned = F.exists("_x", lambda r: F.lower(r).contains("malware scan unavailable"))
    df = df.withColumn(
        "_x",
        F.when(
            no_malware_scan & ~mentioned,
            F.array_append("_x", F.lit(dims.REASON_NO_MALWARE_SCAN)),
        ).otherwise(F.col("_x")),
    )
    safe = F.col("classification") == "Safe"
    empty_text = F.when(safe, dims.REASON_CLEAN).otherwise(dims.REASON_AGGREGATE)
    listed = F.when(F.size("_x") == 0, F.array(empty_text)).otherwise(F.col("_x"))
    low = F.when(F.col("confidence") < 0.5, F.array(F.lit(dims.REASON_LOW_CONFIDENCE))).otherwise(
        no_flags()
    )
    return df.withColumns(
        {
            "reasons": F.when(
                F.size("contributing_engines") == 0, F.array(F.lit(dims.REASON_NO_ENGINE))
            ).otherwise(F.concat(listed, low)),
            "recommended_action": F.when(
                safe & no_malware_scan, F.lit(dims.ACTION_NO_MALWARE_SCAN)
            ).otherwise(lookup(F.col("classification"), dims.ACTIONS, dims.ACTIONS["Safe"])),
        }
    ).drop("_x")
