"""Search of addresses in a table of blocks: the longest block that holds the address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.functions.addresses import address_hex, prefix_key
from riskflow.operators.joins import dim_join


def block_table(ranges: DataFrame, cidr: str = "cidr") -> DataFrame:
    """Blocks ``address/bits`` as rows ``_width, _bits, _prefix, cidr, info``, one per block.

    ``info`` is a struct of the other columns, the least one where a block repeats. Text that is no
    block is left out; bits after the prefix don't count; an address alone is a block of one.
    """
    bits = F.regexp_extract(cidr, r"/(\d{1,3})$", 1)
    rows = ranges.where(F.col(cidr).isNotNull()).withColumns({
        "_number": address_hex(F.regexp_replace(F.trim(cidr), r"/\d{1,3}$", "")),
        "_bits": F.when(bits != "", bits.cast("int")),
    })
    rows = rows.withColumn("_width", F.length("_number")).withColumn("_bits", F.coalesce("_bits", F.col("_width") * 4))
    info = F.struct(*[c for c in ranges.columns if c != cidr]) if len(ranges.columns) > 1 else F.lit(None).cast("string")
    return (
        rows.where("_number is not null and _bits <= _width * 4")
        .withColumn("_prefix", prefix_key(F.col("_number"), F.col("_bits")))
        .groupBy("_width", "_bits", "_prefix")
        .agg(F.min(F.struct(F.col(cidr).alias("cidr"), info.alias("info"))).alias("_block"))
        .select("_width", "_bits", "_prefix", "_block.cidr", "_block.info")
    )


def with_block(df: DataFrame, address: str, ranges: DataFrame, added: str = "block") -> DataFrame:
    """Add ``<added>``: struct ``cidr, info`` of the longest block that holds the address, else null.

    Only distinct addresses are searched. Each asks for its prefix once per block length that the table
    has (at most 162), by equality, so nested and very large tables cost a hash join and no range is
    scanned; answers combine before the shuffle. The rows of ``df`` meet their answer in one join, where
    adaptive execution splits an address that is very frequent. ``info`` holds the other columns of ``ranges``.
    """
    blocks = block_table(ranges)
    lengths = blocks.groupBy("_width").agg(F.collect_set("_bits").alias("_lengths"))
    asked = df.where(F.col(address).isNotNull()).select(F.col(address).alias("_address")).distinct()
    asked = asked.withColumn("_number", address_hex(F.col("_address"))).where("_number is not null")
    asked = asked.withColumn("_width", F.length("_number")).join(F.broadcast(lengths), "_width")
    tries = asked.select("_address", "_width", "_number", F.explode("_lengths").alias("_bits")).select(
        "_address", "_width", "_bits", prefix_key(F.col("_number"), F.col("_bits")).alias("_prefix")
    )
    found = (
        dim_join(tries, blocks, ["_width", "_bits", "_prefix"], "inner")
        .groupBy("_address")
        .agg(F.max_by(F.struct("cidr", "info"), "_bits").alias(added))
    )
    return df.join(found, F.col(address) == F.col("_address"), "left").drop("_address")
