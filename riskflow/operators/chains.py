"""Ends of chains ``node -> next`` by pointer doubling.

Every round joins the pointers with themselves, so a pointer spans twice as many steps; a
chain of n steps takes log2(n) rounds, whatever the number of chains. Pointers that have
reached an end take no part any more. Each round is written once and the round before it is read twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.session import cut


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pointers of ``left`` prolonged by those of ``right``; ``moved`` where there is one."""
    step = right.select(
        F.col("node").alias("at"), F.col("at").alias("_at"), F.col("hops").alias("_hops"), F.col("ok").alias("_ok")
    )
    return left.join(step, "at", "left").select(
        "node",
        F.coalesce("_at", "at").alias("at"),
        (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
        (F.col("ok") & F.coalesce("_ok", F.lit(True))).alias("ok"),
        F.col("_at").isNotNull().alias("moved"),
    )


def follow(links: DataFrame, max_hops: int | None = None) -> tuple[DataFrame, int]:
    """``node, at, hops, ok, cyclic`` per row of ``links(node, next, ok)``, and the number of links.

    ``node`` is unique. ``at`` is the end of the node's chain, or where it is after ``max_hops`` steps;
    ``ok`` holds if it does for all links passed. A chain that never ends is ``cyclic``; without
    ``max_hops`` its ``at`` is null.
    """
    first = cut(links.select("node", F.col("next").alias("at"), F.lit(1).cast("bigint").alias("hops"), "ok"))
    total = first.count()
    if max_hops is not None:
        return _limited(first, max_hops).withColumn("cyclic", F.lit(False)), total
    done = None
    open_ = first
    pointers = first
    while True:
        # what did not move is at its end; more steps than links there are means going round
        after = cut(_joined(open_, pointers))
        ended = after.where(~F.col("moved") | (F.col("hops") > total))
        done = ended if done is None else done.unionByName(ended)
        open_ = after.where(F.col("moved") & (F.col("hops") <= total)).drop("moved")
        if open_.isEmpty():
            break
        pointers = done.unionByName(open_, allowMissingColumns=True).select("node", "at", "hops", "ok")
    cyclic = F.col("moved")
    return done.select(
        "node", F.when(~cyclic, F.col("at")).alias("at"), "hops", "ok", cyclic.alias("cyclic")
    ), total


def _limited(first: DataFrame, steps: int) -> DataFrame:
    """Pointers of at most ``steps`` steps: those of the powers of two that add up to it."""
    found, power = None, first
    while steps:
        if steps & 1:
            found = power if found is None else cut(_joined(found, power).drop("moved"))
        steps >>= 1
        if steps:
            power = cut(_joined(power, power).drop("moved"))
    if found is None:
        return first.select("node", F.col("node").alias("at"), F.lit(0).cast("bigint").alias("hops"), F.lit(True).alias("ok"))
    return found
