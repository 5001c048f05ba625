"""Feedback votes: legacy adapter, validation, first-wins store, schema back-fill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow import dims
from riskflow.functions.columns import filled, lookup, words
from riskflow.schemas import FEEDBACK

FIELDS = [f.split()[0] for f in FEEDBACK.split(", ")]


def adapt_legacy(votes: DataFrame) -> DataFrame:
    """Bring older request shapes to the current columns.

    Older rows name the scan ``analyzed_target`` and vote ``up`` or ``down``.
    """
    has = set(votes.columns)
    get = lambda c, t="string": F.col(c) if c in has else F.lit(None).cast(t)
    words = {"correct": "positive", "accurate": "positive", "incorrect": "negative",
             "inaccurate": "negative"}
    legacy = get("scan_id").isNull() & get("analyzed_target").isNotNull()
    vote = F.coalesce(lookup(get("user_feedback"), words), get("user_feedback"))
    old_vote = F.coalesce(
        lookup(get("feedback_value"), {"up": "positive", "down": "negative"}),
        get("feedback_value"),
    )
    pick = lambda old, new: F.when(legacy, old).otherwise(new)
    adapted = {
        "scan_id": pick(get("analyzed_target"), get("scan_id")),
        "user_feedback": pick(old_vote, vote),
        "classification_at_scan_time": pick(get("category"), get("classification_at_scan_time")),
        "risk_score_at_scan_time": pick(
            get("score", "double"), get("risk_score_at_scan_time", "double")
        ).cast("double"),
        "confidence_at_scan_time": F.coalesce(
            get("confidence_at_scan_time", "double").cast("double"), F.lit(0.0)
        ),
        "source_type": F.coalesce(get("source_type"), F.lit("unknown")),
    }
    rest = [c for c in votes.columns if c not in adapted and c not in (
        "analyzed_target", "feedback_value", "category", "score")]
    return votes.select(*[v.alias(k) for k, v in adapted.items()], *rest)


def validate(votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with ``reason``)."""
    risk, conf = F.col("risk_score_at_scan_time"), F.col("confidence_at_scan_time")
    known = lambda c, values: F.coalesce(F.col(c).isin(values), F.lit(False))
    within = lambda c, top: F.coalesce(c.between(0.0, top) & ~F.isnan(c), F.lit(False))
    reason = F.coalesce(
        F.when(~F.coalesce(F.col("scan_id").rlike(dims.UUID_PATTERN), F.lit(False)), F.lit("scan_id")),
        F.when(~known("user_feedback", ["positive", "negative"]), F.lit("user_feedback")),
        F.when(
            ~known("classification_at_scan_time", dims.CLASSES),
            F.lit("classification_at_scan_time"),
        ),
        F.when(~within(risk, 100.0), F.lit("risk_score_at_scan_time")),
        F.when(~within(conf, 1.0), F.lit("confidence_at_scan_time")),
        F.when(~known("source_type", dims.FEEDBACK_SOURCES), F.lit("source_type")),
    )
    checked = votes.withColumn("reason", reason)
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")


def first_votes(votes: DataFrame, order: str = "arrival_seq") -> DataFrame:
    """First vote per scan by arrival.

    An aggregation with map-side combine: very many repeats of one scan shrink to
    one row per input partition before the shuffle. Rows without a scan id stay.
    """
    rest = [c for c in votes.columns if c not in ("scan_id", order)]
    kept = (
        votes.where("scan_id is not null")
        .groupBy("scan_id")
        .agg(F.min(F.struct(order, *rest)).alias("r"))
        .select("scan_id", "r.*")
        .select(*votes.columns)
    )
    return kept.unionByName(votes.where("scan_id is null"))


def accept(votes: DataFrame, stored: DataFrame, as_of: str, order: str = "arrival_seq") -> DataFrame:
    """Rows to append: first votes of scans that have none stored, with the legacy mirror."""
    new = first_votes(votes, order).join(
        stored.select("scan_id").where("scan_id is not null"), "scan_id", "left_anti"
    )
    return new.select(
        F.col("scan_id").alias("target"),
        F.col("risk_score_at_scan_time").alias("score"),
        F.col("classification_at_scan_time").alias("category"),
        F.when(F.col("user_feedback") == "positive", F.lit("up")).otherwise("down").alias(
            "feedback_value"
        ),
        F.date_format(F.lit(as_of).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        *[F.col(c) for c in FIELDS[:-1]],
        F.coalesce(F.nullif("source_type", F.lit("")), F.lit("unknown")).alias("source_type"),
        F.col(order),
    )


def mark_inserted(votes: DataFrame, stored: DataFrame, order: str = "arrival_seq") -> DataFrame:
    """Every vote with ``inserted``: false for repeats and for scans already stored."""
    winners = first_votes(votes.select("scan_id", order), order).select(
        "scan_id", F.col(order).alias("_first")
    )
    known = stored.select("scan_id").where("scan_id is not null").distinct().withColumn(
        "_known", F.lit(True)
    )
    return (
        votes.join(winners, "scan_id", "left")
        .join(known, "scan_id", "left")
        .withColumn(
            "inserted",
            F.coalesce((F.col(order) == F.col("_first")) & F.col("_known").isNull(), F.lit(False)),
        )
        .drop("_first", "_known")
    )


def read_votes(stored: DataFrame, order: str = "arrival_seq") -> DataFrame:
    """The five evaluation columns of normalized votes, oldest first."""
    return stored.where("scan_id is not null").orderBy(order).select(*FIELDS[1:])


# ------------------------------------------------------------------ schema back-fill
def backfill(df: DataFrame, ddl: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Add the columns of ``ddl`` that a stored table lacks; fill nulls with defaults."""
    wanted = T.StructType.fromDDL(ddl)
    empty = df.sparkSession.createDataFrame([], wanted)
    full = df.unionByName(empty, allowMissingColumns=True)
    fill = {k: F.coalesce(F.col(k), F.lit(v)) for k, v in (defaults or {}).items()}
    return full.withColumns(fill) if fill else full


SENDER_DEFAULTS = {
    "client_id": "anonymous", "first_seen": 0.0, "last_seen": 0.0, "last_domain": "",
    "recent_count": 0, "recent_window_start": 0.0,
}


def known_source(df: DataFrame, sources: list[str], column: str = "source_type") -> DataFrame:
    """Fold unknown or missing source types into ``unknown``."""
    ok = filled(F.col(column)) & F.col(column).isin(sources)
    return df.withColumn(column, F.when(ok, F.col(column)).otherwise("unknown"))
