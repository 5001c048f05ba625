"""Repeat suppression and pending work: debounce, time-limited marks, processed ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.operators.anchors import PART_ROWS, SLICE_US, with_anchor
from riskflow.operators.running import CHUNK_ROWS, with_running

TTL_US = 600_000_000


def debounce(
    df: DataFrame, window: str, content_hash: str, seq: str, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Rows whose content differs from the previous row of the same window."""
    df = with_running(df, [window], seq, {"_before": ("last", F.col(content_hash))}, chunk_rows)
    return df.where(
        F.col("_before").isNull() | (F.col("_before") != F.col(content_hash))
    ).drop("_before")


def ttl_dedup(
    df: DataFrame,
    key: str,
    time_us: str,
    seq: str,
    ttl_us: int = TTL_US,
    succeeded: str | None = None,
    slice_us: int = SLICE_US,
    chunk_rows: int = PART_ROWS,
) -> DataFrame:
    """Add ``accepted``: false while the key's mark is younger than ``ttl_us``.

    The mark is the last accepted row whose scan ``succeeded`` (all rows when no such
    column is named); a failed scan leaves no mark, so the next row is taken again.
    Blank keys are never accepted. Times must not decrease along ``seq``.
    """
    usable = F.coalesce(F.trim(key) != "", F.lit(False))
    df = df.withColumn("_mark_key", F.coalesce(F.trim(key), F.lit("")))
    marked = with_anchor(
        df.where(usable), ["_mark_key"], time_us, [seq], ttl_us, False, succeeded, slice_us, chunk_rows
    )
    free = F.col("anchor_before").isNull() | (F.col(time_us) - F.col("anchor_before") >= ttl_us)
    accepted = marked.withColumn("accepted", free).drop(
        "anchor_before", "is_anchor", "since_anchor"
    )
    return accepted.unionByName(df.where(~usable).withColumn("accepted", F.lit(False))).drop(
        "_mark_key"
    )


def pending(messages: DataFrame, processed: DataFrame, key: str = "message_id") -> DataFrame:
    """Messages that are not processed yet; marks may repeat."""
    return messages.join(processed.select(key), key, "left_anti")


def keep_latest_ids(ids: DataFrame, key: str, seq: str, limit: int = 500) -> DataFrame:
    """Ring of the last ``limit`` distinct ids, by their first mark."""
    first = ids.groupBy(key).agg(F.min(seq).alias(seq))
    return first.orderBy(F.desc(seq), F.desc(key)).limit(limit)


def live_sessions(events: DataFrame, users: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events joined with the user of a session that is live at event time.

    ``events(token, ts)``, ``sessions(token, user_id, expires_at)``, ``users(user_id)``.
    """
    s = sessions.withColumnRenamed("token", "_token")
    live = (F.trim(events["token"]) == s["_token"]) & (s["expires_at"] > events["ts"])
    return events.join(s, live, "inner").drop("_token").join(users, "user_id")
