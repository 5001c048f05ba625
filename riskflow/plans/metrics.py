"""Feedback evaluation metrics, history statistics and inbox summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow import dims


def _counted(votes: DataFrame) -> DataFrame:
    known = F.col("user_feedback").isin("positive", "negative") & F.col(
        "classification_at_scan_time"
    ).isin(dims.CLASSES)
    source = F.col("source_type")
    return votes.where(known).select(
        "user_feedback",
        F.col("classification_at_scan_time").alias("classification"),
        F.col("risk_score_at_scan_time").alias("risk"),
        F.when(source.isin(dims.FEEDBACK_SOURCES), source).otherwise("unknown").alias("source"),
    )


def _rate(part: str, total: str):
    return F.coalesce(F.col(part) / F.nullif(total, F.lit(0)), F.lit(0.0))


def feedback_totals(votes: DataFrame) -> DataFrame:
    """One row: counts, rates (0 when empty) and mean risk (null when none)."""
    positive = F.col("user_feedback") == "positive"
    return (
        _counted(votes)
        .agg(
            F.count(F.lit(1)).alias("total_feedback_count"),
            F.count_if(positive).alias("positive_feedback_count"),
            F.count_if(~positive).alias("negative_feedback_count"),
            F.avg(F.when(positive, F.col("risk"))).alias("average_risk_score_positive"),
            F.avg(F.when(~positive, F.col("risk"))).alias("average_risk_score_negative"),
        )
        .withColumns(
            {
                "positive_feedback_rate": _rate("positive_feedback_count", "total_feedback_count"),
                "negative_feedback_rate": _rate("negative_feedback_count", "total_feedback_count"),
            }
        )
    )


def feedback_by_class(votes: DataFrame) -> DataFrame:
    """Counts and rates for all five classes, zero-filled."""
    counted = _counted(votes).groupBy("classification").pivot(
        "user_feedback", ["positive", "negative"]
    ).count()
    dim = votes.sparkSession.createDataFrame([(c,) for c in dims.CLASSES], "classification string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(f"{c}_count")
    return (
        dim.join(counted, "classification", "left")
        .select("classification", zero("positive"), zero("negative"))
        .withColumn("total_count", F.col("positive_count") + F.col("negative_count"))
        .withColumns(
            {
                "positive_rate": _rate("positive_count", "total_count"),
                "negative_rate": _rate("negative_count", "total_count"),
            }
        )
    )


def feedback_by_source(votes: DataFrame) -> DataFrame:
    counted = _counted(votes).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    dim = votes.sparkSession.createDataFrame([(s,) for s in dims.FEEDBACK_SOURCES], "source string")
    return dim.join(counted, "source", "left").select(
        F.col("source").alias("source_type"), F.coalesce("n", F.lit(0)).alias("feedback_count")
    )


def evaluation_metrics(votes: DataFrame) -> DataFrame:
    """One row with the maps by class and source, as a report carries it."""
    classes = feedback_by_class(votes).agg(
        F.map_from_entries(F.collect_list(F.struct("classification", "total_count"))).alias(
            "feedback_count_by_classification"
        ),
        F.map_from_entries(
            F.collect_list(
                F.struct(
                    "classification",
                    F.struct(
                        "total_count", "positive_count", "negative_count", "positive_rate",
                        "negative_rate",
                    ),
                )
            )
        ).alias("classification_feedback_summary"),
    )
    sources = feedback_by_source(votes).agg(
        F.map_from_entries(F.collect_list(F.struct("source_type", "feedback_count"))).alias(
            "feedback_count_by_source_type"
        )
    )
    # one-row frames of fixed size, put side by side on a constant key
    one = lambda df: df.withColumn("_one", F.lit(1))
    return (
        one(feedback_totals(votes)).join(one(classes), "_one").join(one(sources), "_one").drop("_one")
    )


def history_stats(history: DataFrame) -> DataFrame:
    return history.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("classification").isin(dims.CLASSES[1:])).alias("threats"),
    )


def _inbox(history: DataFrame, among: int | None) -> DataFrame:
    """Mail rows, all of them or those among the latest ``among`` of all sources."""
    if among is not None:
        history = history.orderBy(F.desc("timestamp_millis"), F.desc("scan_id")).limit(among)
    return history.where(F.col("source_type").isin("gmail", "demo"))


def inbox_summary(history: DataFrame, among: int | None = None) -> DataFrame:
    return (
        _inbox(history, among)
        .agg(
            F.count(F.lit(1)).alias("audited"),
            F.count_if(F.col("classification") != "Safe").alias("threats"),
        )
        .withColumn(
            "integrity",
            F.when(F.col("audited") == 0, F.lit(100).cast("bigint")).otherwise(
                F.greatest(F.lit(0).cast("bigint"), 100 - F.col("threats") * 25)
            ),
        )
    )


def inbox_latest(history: DataFrame, n: int = 5, among: int | None = None) -> DataFrame:
    return _inbox(history, among).orderBy(F.desc("timestamp_millis"), F.desc("scan_id")).limit(n)
