"""Running values per key that stay parallel for a hot key.

A plain window over a key sends every row of that key to one task. Here the
sequence number is cut into chunks: partial values per (key, chunk) are
aggregated map-side, carried across the few chunk rows of a key, and the rows
themselves are only ordered inside their own chunk. Sequence numbers are unique,
so no group ever holds more than ``chunk_rows`` rows, whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 5_000_000


def with_running(
    df: DataFrame,
    keys: list[str],
    seq: str,
    values: dict[str, tuple[str, Column]],
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add, for each ``out: (kind, column)``, the value over all earlier rows of the key.

    Kinds: ``sum``, ``max``, ``bit_or`` (null when no earlier row), ``first`` and
    ``last`` (of the non-null values) and ``count`` (of the non-null values).
    """
    chunk = "_chunk"
    df = df.withColumn(chunk, F.floor(F.col(seq) / F.lit(chunk_rows)))
    work = df.withColumns({f"_v_{o}": c for o, (_, c) in values.items()})

    def partial(out: str, kind: str) -> Column:
        v = F.col(f"_v_{out}")
        if kind == "first":
            return F.min(F.when(v.isNotNull(), F.struct(F.col(seq), v.alias("v"))))["v"]
        if kind == "last":
            return F.max(F.when(v.isNotNull(), F.struct(F.col(seq), v.alias("v"))))["v"]
        return {"sum": F.sum, "max": F.max, "bit_or": F.bit_or, "count": F.count}[kind](v)

    def over(out_col: Column, kind: str, window, merged: bool) -> Column:
        if kind == "first":
            return F.first(out_col, ignorenulls=True).over(window)
        if kind == "last":
            return F.last(out_col, ignorenulls=True).over(window)
        if kind == "count":
            return (F.sum(out_col) if merged else F.count(out_col)).over(window)
        return {"sum": F.sum, "max": F.max, "bit_or": F.bit_or}[kind](out_col).over(window)

    def combine(out: str, kind: str) -> Column:
        carry, inner = F.col(f"_c_{out}"), F.col(f"_i_{out}")
        if kind == "first":
            return F.coalesce(carry, inner)
        if kind == "last":
            return F.coalesce(inner, carry)
        if kind == "count":
            return F.coalesce(carry, F.lit(0)) + F.coalesce(inner, F.lit(0))
        if kind == "max":
            return F.greatest(carry, inner)
        if kind == "sum":
            return F.when(
                carry.isNotNull() | inner.isNotNull(),
                F.coalesce(carry, F.lit(0)) + F.coalesce(inner, F.lit(0)),
            )
        return F.when(
            carry.isNotNull() | inner.isNotNull(),
            F.coalesce(carry, F.lit(0)).bitwiseOR(F.coalesce(inner, F.lit(0))),
        )

    earlier_chunks = (
        Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier_rows = (
        Window.partitionBy(*keys, chunk).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        work.groupBy(*keys, chunk)
        .agg(*[partial(o, k).alias(f"_p_{o}") for o, (k, _) in values.items()])
        .select(
            *keys,
            chunk,
            *[
                over(F.col(f"_p_{o}"), k, earlier_chunks, True).alias(f"_c_{o}")
                for o, (k, _) in values.items()
            ],
        )
    )
    joined = work.join(carried, [*keys, chunk], "left").withColumns(
        {
            f"_i_{o}": over(F.col(f"_v_{o}"), k, earlier_rows, False)
            for o, (k, _) in values.items()
        }
    )
    result = joined.withColumns({o: combine(o, k) for o, (k, _) in values.items()})
    return result.select(*[c for c in df.columns if c != chunk], *values)
