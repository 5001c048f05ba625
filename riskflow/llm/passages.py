"""Runs of words that several texts share.

A window of ``least`` words (runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``) is shared if
the same words in the same order also stand in another row; blanks may differ.

1. In every window the smallest hash of ``gram`` words is its anchor, so equal windows have equal
   anchors at equal places. Anchors of one row only cannot carry a shared window.
2. The windows at the other anchors are named by a digest of their words; a name found in two rows
   is shared.

Defined results: a null text has no words; repeated rows share their windows; a window that occurs
twice in one row only is not shared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import encoded, flags, shingle_hashes, stage, word_hashes

STRETCH = 1 << 20
PLACE = np.uint64(22)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def smallest(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of every ``width`` neighbours, the first of equals."""
    n = len(hashes) - width + 1
    out = np.empty(max(n, 0), np.int64)
    for start in range(0, n, STRETCH):
        part = hashes[start : start + STRETCH + width - 1]
        key = (part >> PLACE << PLACE) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while 2 * size <= width:  # doubling
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        rest = width - size
        key = np.minimum(key[: len(key) - rest], key[rest:])
        out[start : start + len(key)] = (key & np.uint64((1 << 22) - 1)).astype(np.int64) + start
    return out


def anchors(words: list[bytes], least: int, gram: int) -> np.ndarray:
    """Hash of the anchor of every window of ``least`` words."""
    if len(words) < least:
        return np.empty(0, np.uint64)
    hashes = shingle_hashes(word_hashes(words), gram)
    return hashes[smallest(hashes, least - gram + 1)]


def shared(rows: DataFrame, least: int, gram: int = 8, bits: int = 24) -> DataFrame:
    """``row, start, end``: byte ranges of the shared windows of ``rows(row, text)``."""

    def all_anchors(batches):
        for batch in batches:
            found = [np.unique(anchors(encoded(t.as_py()).split(), least, gram)) for t in batch.column(1)]
            flat = np.concatenate(found) if found else np.empty(0, np.uint64)
            row = np.repeat(batch.column(0).to_numpy(), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(row, pa.int64())], ["anchor", "row"])

    rows = rows.select("row", "text")
    spread = [F.min("row").alias("low"), F.max("row").alias("high")]
    several = rows.mapInArrow(all_anchors, "anchor long, row long").groupBy("anchor").agg(*spread).where("low < high")
    low = several.select(F.col("anchor").bitwiseAND((1 << bits) - 1).alias("slot"))
    sent = rows.sparkSession.sparkContext.broadcast(flags(low, "slot", bits))
    names, kinds = ["name", "row", "start", "end"], [pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def windows(batches):
        mask = np.uint64(len(sent.value) - 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                cols: list[list] = [[] for _ in names]
                for row, text in zip(part.column(0).to_pylist(), part.column(1)):
                    raw = encoded(text.as_py())
                    words = raw.split()
                    hot = np.flatnonzero(sent.value[(anchors(words, least, gram) & mask).astype(np.int64)])
                    if not len(hot):
                        continue
                    packed = b" ".join(words)
                    ends = np.cumsum([len(w) + 1 for w in words])  # one past the blank
                    first, last = np.r_[0, ends[:-1]][hot].tolist(), (ends[hot + least - 1] - 1).tolist()
                    cols[0] += [hashlib.blake2b(packed[a:z], digest_size=16).digest() for a, z in zip(first, last)]
                    cols[1] += [row] * len(hot)
                    edge = np.flatnonzero(np.diff(np.r_[True, BLANK[np.frombuffer(raw, np.uint8)], True].view(np.int8)))
                    cols[2] += edge[::2][hot].tolist()
                    cols[3] += edge[1::2][hot + least - 1].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    named = stage(rows.mapInArrow(windows, "name binary, row long, start long, end long"), "passages")
    twice = named.groupBy("name").agg(*spread).where("low < high").select("name")
    return named.join(twice, "name", "left_semi").select("row", "start", "end")
