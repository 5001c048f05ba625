"""Shards along a Hilbert curve over quantised metadata; DataFrame functions only.

Each dimension is cut into ``2**bits`` classes at quantiles of all rows (text dimensions by
their first seven bytes, so classes are ranges of values). The classes are the coordinates
of a cell; cells are ordered by their Hilbert index and the ordered rows are cut into runs.
Rows of a file then lie close together in every dimension and the files' minima and maxima
prune on each of them.

Rows with one index are ordered by a hash of the id, so a hot cell is split like any other
run of rows. Defined results: null is the lowest class of a dimension; null text has no
bytes; repeated rows get slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import stage


def ordinal(df: DataFrame, name: str) -> Column:
    """An order-preserving number: the value itself, or the first seven bytes of a text."""
    kind = dict(df.dtypes)[name]
    if kind != "string":
        return F.col(name).cast("double")
    head = F.substring(F.rpad(F.hex(F.col(name).cast("binary")), 14, "0"), 1, 14)
    return F.conv(head, 16, 10).cast("double")


def edges(df: DataFrame, dims: list[str], bits: int) -> list[list[float]]:
    """Quantiles that cut each dimension; one row of ``len(dims) * (2**bits - 1)`` numbers."""
    n = 1 << bits
    at = F.array(*[F.lit(i / n) for i in range(1, n)])
    row = df.agg(*[F.percentile_approx(ordinal(df, d), at, 2000).alias(f"d{i}") for i, d in enumerate(dims)]).first()
    return [sorted(set(v or [])) for v in row]


def curve(n: int, bits: int) -> str:
    """SQL for the Hilbert index of the array ``x`` of ``n`` coordinates of ``bits`` bits.

    Skilling's method: undo the rotations bit by bit, Gray-code, interleave the bits.
    """
    step = (
        "transform(a, (v, j) -> CASE WHEN (a[i] & q) != 0 THEN IF(j = 0, v ^ (q - 1), v) "
        "WHEN j = 0 OR j = i THEN v ^ ((a[0] ^ a[i]) & (q - 1)) ELSE v END)"
    )
    turned = (
        f"aggregate(transform(sequence(1, {bits - 1}), b -> shiftleft(1, {bits} - b)), x, "
        f"(y, q) -> aggregate(sequence(0, {n - 1}), y, (a, i) -> {step}))"
        if bits > 1
        else "x"
    )
    gray = (
        f"transform({turned}, (v, j) -> v)"
        if n == 1
        else f"aggregate(sequence(1, {n - 1}), {turned}, "
        "(a, i) -> transform(a, (v, j) -> IF(j = i, v ^ a[i - 1], v)))"
    )
    flip = (
        f"aggregate(sequence(1, {bits - 1}), 0, (t, b) -> "
        f"IF((g[{n - 1}] & shiftleft(1, b)) != 0, t ^ (shiftleft(1, b) - 1), t))"
        if bits > 1
        else "0"
    )
    bit = f"(shiftright(z[j % {n}], {bits - 1} - CAST(j / {n} AS INT)) & 1)"
    return (
        f"aggregate(transform(array({gray}), g -> transform(g, v -> v ^ {flip})), 0L, (s, z) -> "
        f"aggregate(sequence(0, {n * bits - 1}), 0L, (s2, j) -> shiftleft(s2, 1) + {bit}))"
    )


def with_index(df: DataFrame, dims: list[str], bits: int = 4, out: str = "hilbert") -> DataFrame:
    """Add the Hilbert index of the row's cell.

    The index is computed once per cell, in a table of ``2**(bits * len(dims))`` rows.
    """
    n = len(dims)
    if n * bits > 16:
        raise ValueError("at most 2**16 cells")
    code = F.lit(0)
    for d, cuts in zip(dims, edges(df, dims, bits)):
        value = ordinal(df, d)
        level = sum((F.when(value > c, 1).otherwise(0) for c in cuts), F.when(value.isNull(), 0).otherwise(0))
        code = code * (1 << bits) + level
    cells = df.sparkSession.range(1 << (n * bits)).select(
        F.col("id").cast("int").alias("_cell"),
        F.expr(
            f"transform(sequence({n - 1}, 0, -1), k -> CAST(shiftright(id, k * {bits}) & {(1 << bits) - 1} AS INT))"
            if n > 1
            else "array(CAST(id AS INT))"
        ).alias("x"),
    )
    cells = cells.select("_cell", F.expr(curve(n, bits)).alias(out))
    return df.withColumn("_cell", code).join(F.broadcast(cells), "_cell").drop("_cell")


def shard(df: DataFrame, shards: int, index: str, ident: str, partitions: int | None = None) -> DataFrame:
    """Cut the rows, ordered by ``index``, into ``shards`` runs whose counts differ by one at most.

    Adds ``shard`` and ``slot`` (position in the run). Ranks come from ranges of rows: each
    range is ranked by itself and starts where the counts of the earlier ranges end.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = [F.xxhash64(ident).alias("_tie")]
    order = [index, "_tie", *[c for c in df.columns if c != index]]
    ranged = (
        df.select("*", *tie)
        .repartitionByRange(parts, *order)
        .withColumn("_range", F.spark_partition_id())
    )
    rows = stage(ranged, "hilbert-ranges")
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    upto = Window.orderBy("_range")  # one row per range
    starts = counts.select(
        "_range",
        (F.sum("_n").over(upto) - F.col("_n")).alias("_start"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"),
    )
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    rank = (F.col("_start") + F.col("_at")).alias("_rank")
    ranked = rows.withColumn("_at", at).join(F.broadcast(starts), "_range").select("*", rank)
    cut = F.expr(f"CAST(_rank * {shards} DIV _total AS INT)")
    begin = F.expr(f"(shard * _total + {shards - 1}) DIV {shards}")
    return (
        ranked.withColumn("shard", cut)
        .withColumn("slot", F.col("_rank") - begin)
        .drop("_range", "_start", "_total", "_at", "_rank", "_tie")
    )


def write(sharded: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Files in curve order under one folder per shard."""
    (
        sharded.repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.option("maxRecordsPerFile", rows_per_file)
        .partitionBy("shard")
        .parquet(path)
    )


__all__ = ["curve", "edges", "ordinal", "shard", "with_index", "write"]
