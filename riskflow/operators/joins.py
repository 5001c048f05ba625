"""Joins against reference tables of checked size, and filters on derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def is_small(table: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when the table is proven to hold at most ``max_rows`` rows.

    Reads at most ``max_rows + 1`` rows, so the check stays cheap on a big table.
    """
    return table.limit(max_rows + 1).count() <= max_rows


def dim_join(
    facts: DataFrame,
    dim: DataFrame,
    on: str | list[str] | Column,
    how: str = "left",
    small: bool | None = None,
) -> DataFrame:
    """Join a fact table with a keyed reference table (one row per key).

    A small reference table is broadcast and the facts do not move. A big one is
    joined by shuffle, where adaptive execution splits hot keys of the fact side.
    """
    if is_small(dim) if small is None else small:
        dim = F.broadcast(dim)
    return facts.join(dim, on, how)


def keep_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Filter behind a generator.

    A plain filter on a column with a long derivation is pushed below every
    projection it came from, and its text grows at each of them until planning
    takes longer than the job. A generator that emits one row or none stops that.
    """
    one_or_none = F.expr("array(true)")
    return (
        df.withColumn("_keep", condition)
        .select("*", F.explode(F.when(F.col("_keep"), one_or_none)).alias("_kept"))
        .drop("_keep", "_kept")
    )
