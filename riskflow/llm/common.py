"""Helpers shared by the operators: intermediate tables and word splitting.

Words are runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``. ``bytes.split()`` cuts at
exactly these bytes, so words are cut in UTF-8, where no other character contains them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.session import checkpoint_root, ship_package

WORD = r"[^\x20\x09-\x0D]+"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stage(df: DataFrame, name: str, schema: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Cuts lineage: a lost executor costs a re-read, not a recomputation, and rows do
    not change between two reads. The folder goes when the session ends, or earlier by
    :func:`drop`.
    """
    spark = df.sparkSession
    root = spark.conf.get("riskflow.llm.stage.dir", None)
    if root is None:
        root = checkpoint_root(spark).rstrip("/") + "/riskflow-llm"
        spark.conf.set("riskflow.llm.stage.dir", root)
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    jpath, fs = _fs(spark, path)
    df.write.parquet(path)
    fs.deleteOnExit(jpath)
    out = spark.read.schema(schema or df.schema).parquet(path)
    out._stage_path = path
    for bag in _BAGS:
        bag.append(out)
    return out


_BAGS: list[list[DataFrame]] = []


@contextmanager
def collecting(bag: list[DataFrame]) -> Iterator[list[DataFrame]]:
    """Note the tables that are staged inside, so that :func:`drop` can remove them."""
    _BAGS.append(bag)
    try:
        yield bag
    finally:
        _BAGS.pop()


def free(name: str, taken: list[str]) -> str:
    """``name``, or the first longer form of it that no column has (case aside)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def drop(*tables: DataFrame) -> None:
    """Remove staged tables that no later step reads."""
    for table in tables:
        path = getattr(table, "_stage_path", None)
        if path:
            jpath, fs = _fs(table.sparkSession, path)
            fs.delete(jpath, True)


def prepare(spark: SparkSession) -> None:
    """Ship the package and keep Arrow batches of long texts small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def flags(df: DataFrame, slot: str, bits: int) -> np.ndarray:
    """Which of the numbers ``0 .. 2**bits - 1`` occur in column ``slot``.

    Aggregated as bitmaps map-side; the driver receives at most ``2**bits`` bits.
    """
    one = F.col(slot).cast("long") + 1
    rows = df.groupBy(F.bitmap_bucket_number(one).alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits")
    )
    out = np.zeros(max(1 << bits, 32768), bool)
    for r in rows.collect():
        at = (r.b - 1) * 32768
        out[at : at + 32768] = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")[:32768].astype(bool)
    return out[: 1 << bits]


def encoded(text: str | None) -> bytes:
    """UTF-8 bytes; a lone surrogate, which no Spark string holds, would become ``?``."""
    return b"" if text is None else text.encode("utf-8", "replace")


MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


#: odd multipliers, one per word of a shingle
WEIGHTS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per window of ``width`` words; the whole sequence when there are fewer words."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(width, n)
    out = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        out += hashes[i : n - k + 1 + i] * WEIGHTS[i]
    return mix(out)
