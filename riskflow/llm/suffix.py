"""Removal of long repeated byte strings, found by sorting suffixes.

A byte goes if a string of ``width`` bytes that also starts anywhere else covers it.

1. Naming. In every window of ``width`` bytes the smallest hash of ``gram`` bytes is its
   anchor, so equal windows have equal anchors at equal places. Anchors that occur once in
   the corpus cannot carry a repeat. The windows of the others are named by blocks: all
   windows of a block share a core of bytes, and blocks with equal cores form a shard.
   Equal blocks of one shard get one name; a name that occurs twice marks all its windows.
2. Sorting. Where a shard has different blocks, one of each is laid out and the suffixes are sorted by external
   induction (:mod:`riskflow.llm.induced`); neighbours with a common prefix of
   ``width`` bytes mark their windows.
3. The marks of every document are merged and its bytes cut.

A shard is bounded by its distinct blocks, not by their copies; a task sorts its shards in
lots, and the queues of a lot that is larger than memory keep their runs on disk.

Rows are numbered once and written with their number, so all passes see the same ones however
the source is split. Defined
results: a null text has no bytes; texts shorter than ``width`` stay as they are; repeated
rows are repeats of each other; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import collecting, drop, encoded, flags, free, mix, stage
from riskflow.llm.induced import in_folder
from riskflow.llm.passages import shared

SEGMENT = 1 << 20
BASE = 0x9E3779B97F4A7C15
BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    step = 1
    while step < n:  # doubling
        out[step : 2 * step] = out[: min(step, n - step)] * np.uint64(pow(base, step, 1 << 64))
        step *= 2
    return out


_POWERS: dict[int, np.ndarray] = {}


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from every position."""
    n = len(data)
    if not _POWERS:
        _POWERS[1] = _powers(BASE, SEGMENT * 2)
        _POWERS[-1] = _powers(pow(BASE, -1, 1 << 64), SEGMENT * 2)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[data] * _POWERS[1][:n], out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * _POWERS[-1][: n - gram + 1])


def anchors(data: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For runs of window starts with one anchor: first start, and the anchor's position."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    firsts, places = [], []
    for start in range(0, n, SEGMENT):  # window starts of this stretch
        stop = min(start + SEGMENT, n)
        part = data[start : stop + width - 1]
        key = (gram_hashes(part, gram) >> np.uint64(22) << np.uint64(22)) | np.arange(len(part) - gram + 1, dtype=np.uint64)
        w = width - gram + 1
        # minima of sliding windows: from the left and from the right of blocks
        pad = -len(key) % w
        blocks = np.r_[key, np.full(pad, np.uint64(2**64 - 1))].reshape(-1, w)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        m = stop - start
        place = (np.minimum(right[:m], left[w - 1 : w - 1 + m]) & np.uint64((1 << 22) - 1)).astype(np.int64) + start
        new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        firsts.append(new + start)
        places.append(place[new])
    return np.concatenate(firsts), np.concatenate(places)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _anchor_hashes(rows: DataFrame, width: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(0):
                data = np.frombuffer(encoded(text.as_py()), np.uint8)
                _, place = anchors(data, width, gram)
                place = np.unique(place)
                if len(place):
                    # only the grams at anchors are hashed; the value does not depend on the stretch
                    view = np.lib.stride_tricks.sliding_window_view(data, gram)[place]
                    out.append(_own_hash(view))
            flat = np.concatenate(out) if out else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64))], ["anchor"])

    return rows.select("text").mapInArrow(run, "anchor long")


def _own_hash(grams: np.ndarray) -> np.ndarray:
    return mix((BYTE[grams] * _powers(BASE, grams.shape[1])).sum(axis=1, dtype=np.uint64))


def _blocks(rows: DataFrame, seen: np.ndarray, width: int, gram: int, step: int, wanted: np.ndarray | None) -> DataFrame:
    """Blocks of windows at repeated anchors: ``core, name, row, first, last``.

    With ``wanted`` (flags of rows) only blocks of those rows, and their bytes in ``data``.
    """
    context = rows.sparkSession.sparkContext
    sent, chosen = context.broadcast(seen), context.broadcast(wanted)
    names = ["core", "name", "row", "first", "last"] + (["data"] if wanted is not None else [])

    def run(batches):
        low, pick = np.uint64(len(sent.value) - 1), chosen.value
        for batch in batches:
            if pick is not None:
                batch = batch.filter(pa.array(pick[batch.column(2).to_numpy()]))
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                cols: list[list] = [[] for _ in names]
                for row, text in zip(part.column(0).to_pylist(), part.column(1)):
                    raw = encoded(text.as_py())
                    data = np.frombuffer(raw, np.uint8)
                    first, place = anchors(data, width, gram)
                    if not len(first):
                        continue
                    view = np.lib.stride_tricks.sliding_window_view(data, gram)
                    last = np.r_[first[1:], len(data) - width + 1] - 1
                    hot = sent.value[(_own_hash(view[place]) & low).astype(np.int64)]
                    for a, z, p in zip(first[hot].tolist(), last[hot].tolist(), place[hot].tolist()):
                        for b in range((p - z) // step, (p - a) // step + 1):
                            i0, i1 = max(a, p - (b + 1) * step + 1), min(z, p - b * step)
                            core = raw[p - b * step : p - (b + 1) * step + 1 + width]
                            cols[0].append(digest(core + b.to_bytes(2, "little")))
                            cols[1].append(digest((i0 - p + (1 << 30)).to_bytes(4, "little") + raw[i0 : i1 + width]))
                            cols[2].append(row)
                            cols[3].append(i0)
                            cols[4].append(i1)
                            if len(cols) > 5:
                                cols[5].append(raw[i0 : i1 + width])
                kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    schema = "core binary, name binary, row long, first int, last int" + (", data binary" if wanted is not None else "")
    return rows.mapInArrow(run, schema)


def _sorted_marks(blocks: DataFrame, width: int, lot: int) -> DataFrame:
    """``core, name, offsets``: window starts within a block that also occur in another block of the shard."""
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(parts, "core").sortWithinPartitions("core", "name")

    def judge(items: list[tuple[bytes, bytes, bytes]]):
        # one text: bytes + 5 and a terminator of its own after each block, in base 4
        ends, parts = [], []
        digits = max(1, (len(items).bit_length() + 1) // 2)
        for i, (_, _, data) in enumerate(items):
            tail = [(i >> (2 * d)) & 3 for d in range(digits)]
            parts += [np.frombuffer(data, np.uint8).astype(np.uint16) + 5, np.array([4, *tail], np.uint16)]
            ends.append(len(data))
        text = np.concatenate(parts)
        sa, lcp = in_folder(text)
        same = lcp >= width
        hit = np.zeros(len(text), bool)
        hit[sa[same]] = True
        hit[sa[np.flatnonzero(same) - 1]] = True
        at = 0
        for (core, name, _), n in zip(items, ends):
            found = np.flatnonzero(hit[at : at + n - width + 1])
            if len(found):
                yield core, name, found.tolist()
            at += n + 1 + digits

    def run(batches):
        items, size, now = [], 0, None
        for batch in batches:
            rows = []
            for core, name, data in zip(*(batch.column(c).to_pylist() for c in ("core", "name", "data"))):
                if size > lot and core != now:
                    rows += judge(items)
                    items, size = [], 0
                items.append((core, name, data))
                size, now = size + len(data), core
            yield made(rows)
        yield made(list(judge(items)) if items else [])

    def made(rows):
        cols = list(zip(*rows)) if rows else [[], [], []]
        kinds = (pa.binary(), pa.binary(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], ["core", "name", "offsets"])

    return dealt.select("core", "name", "data").mapInArrow(run, "core binary, name binary, offsets array<int>")


def marks(rows: DataFrame, width: int, gram: int = 64, step: int = 64, bits: int = 24, lot: int = 700_000) -> DataFrame:
    """``row, start, end``: ranges of window starts that occur twice, of ``rows(row, text)``."""
    grams = _anchor_hashes(rows, width, gram).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    low = grams.select(F.col("anchor").bitwiseAND((1 << bits) - 1).alias("low"))
    seen = flags(low, "low", bits)
    slot = F.xxhash64("row").bitwiseAND((1 << 20) - 1).alias("slot")
    slotted = rows.select("row", "text", slot)
    blocks = stage(_blocks(slotted, seen, width, gram, step, None), "suffix-blocks")
    named = blocks.groupBy("core", "name").agg(
        F.count("*").alias("n"), F.min(F.struct("row", "first")).alias("lead")
    )
    shards = named.groupBy("core").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).where("all > 1")
    named = stage(named.join(shards, "core"), "suffix-names")
    mixed = named.where("kinds > 1").select("core", "name", F.col("lead.row").alias("row"), F.col("lead.first").alias("first"))
    wanted = flags(mixed.select(slot), "slot", 20)
    laid = _blocks(slotted, seen, width, gram, step, wanted).join(
        mixed, ["core", "name", "row", "first"], "left_semi"
    )
    sorted_marks = stage(_sorted_marks(laid, width, lot), "suffix-sorted")
    twice = named.where("n > 1").select("core", "name")
    whole = blocks.join(twice, ["core", "name"], "left_semi").select(
        "row", F.col("first").alias("start"), (F.col("last") + 1).alias("end")
    )
    single = blocks.join(sorted_marks, ["core", "name"]).join(twice, ["core", "name"], "left_anti").select(
        "row", F.explode("offsets").alias("o"), "first"
    ).select("row", (F.col("first") + F.col("o")).alias("start"), (F.col("first") + F.col("o") + 1).alias("end"))
    return whole.union(single)


def cut(docs: DataFrame, width: int = 400, words: int | None = None, **options) -> DataFrame:
    """``docs`` with ``kept`` (the remaining bytes), ``n_bytes``, ``n_removed`` and ``n_spans``.

    With ``words`` the runs of so many words that another row also has go too, however few bytes
    they take. Columns of these names in ``docs`` are replaced.
    """
    new = ["kept", "n_bytes", "n_removed", "n_spans"]
    names = [c for c in docs.columns if c not in new]
    number, ranges_of = free("_row", names), free("_marks", names)
    base = stage(docs.select(*names, F.monotonically_increasing_id().alias(number)), "suffix-rows")
    rows = base.select(F.col(number).alias("row"), "text")
    with collecting([]) as used:
        found = marks(rows, width, **options).select("row", F.col("start").cast("long"), (F.col("end") + width - 1).cast("long").alias("end"))
        if words is not None:
            found = found.union(shared(rows, words))
        per_row = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(ranges_of))
        # narrow; what it was made of goes at once
        per_row = stage(per_row.withColumnRenamed("row", number), "suffix-marks")
    drop(*used[:-1])
    joined = base.join(per_row, number, "left").select(*names, ranges_of)
    fields = ", ".join(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in names)
    at = names.index("text")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                out: list[list] = [[], [], [], []]
                for text, ranges in zip(part.column(at), part.column(len(names)).to_pylist()):
                    raw = encoded(text.as_py())
                    edge = np.zeros(len(raw) + 1, np.int64)
                    for r in ranges or ():
                        edge[r["start"]] += 1
                        edge[r["end"]] -= 1
                    gone = np.cumsum(edge)[:-1] > 0
                    data = np.frombuffer(raw, np.uint8)
                    out[0].append(data[~gone].tobytes() if ranges else raw)
                    out[1].append(len(raw))
                    out[2].append(int(gone.sum()))
                    out[3].append(int((gone & ~np.r_[False, gone[:-1]]).sum()))
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *(pa.array(c, t) for c, t in zip(out, kinds))], [*names, *new]
                )

    return joined.mapInArrow(run, f"{fields}, kept binary, n_bytes long, n_removed long, n_spans long")


__all__ = ["anchors", "cut", "marks"]
