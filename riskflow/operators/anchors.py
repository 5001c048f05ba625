"""Anchored windows: decisions that depend on the last anchor, not on a frame.

A row becomes the next anchor when its time lies ``width`` beyond the current
anchor. The chain is sequential per key, so it is solved in three steps that keep
a hot key parallel:

1. per part (key, time slice, block of sequence numbers): a step table "entry anchor ->
   exit anchor" (only rows of the first ``width`` of a part can change the entry);
2. per key: a walk along the step tables, which are streamed step by step;
3. per part: mark the anchors, now that the entry anchor is known.

Sequence numbers are unique, so a part holds at most ``chunk_rows`` rows whatever the key, and
nothing larger is ever held. Rows are narrow and Spark does the partitioning and sorting;
numpy only works on the sorted times of one part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_US = 6 * 3600 * 1_000_000
PART_ROWS = 100_000
_NONE = np.iinfo(np.int64).min


def map_sorted_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    fn: Callable[[pa.Table, np.ndarray], pa.Table],
    schema: T.StructType,
) -> DataFrame:
    """Apply ``fn(rows, starts)`` to complete groups of key-partitioned, sorted rows.

    ``starts`` holds the first row of every group. A group that spans several Arrow
    batches is held until it is complete; groups themselves are bounded by the caller.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            last = _group_starts(pa.Table.from_batches([batch]), keys)[-1]
            if last == 0 and (not held or _same_key(held[-1], batch, keys)):
                held.append(batch)
                continue
            table = pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
            if table.num_rows:
                yield from fn(table, _group_starts(table, keys)).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from fn(table, _group_starts(table, keys)).to_batches()

    return (
        df.repartition(*keys)
        .sortWithinPartitions(*keys, *order)
        .mapInArrow(run, schema)
    )


def _same_key(left: pa.RecordBatch, right: pa.RecordBatch, keys: list[str]) -> bool:
    return all(left[k][left.num_rows - 1].as_py() == right[k][0].as_py() for k in keys)


def _group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    changed = np.zeros(table.num_rows, dtype=bool)
    if table.num_rows == 0:
        return np.array([0])
    changed[0] = True
    for key in keys:
        codes = table[key].combine_chunks().dictionary_encode()
        codes = codes.indices if isinstance(codes, pa.DictionaryArray) else pa.chunked_array(
            [c.indices for c in codes.chunks]
        )
        values = codes.to_numpy(zero_copy_only=False)
        changed[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(changed)


def _next_index(times: np.ndarray, anchor, width: int, strict: bool) -> int:
    if anchor == _NONE:
        return 0
    return int(np.searchsorted(times, anchor + width, side="right" if strict else "left"))


def _step_table(times: np.ndarray, width: int, strict: bool):
    """Breaks, exit anchors and rows since the exit anchor of one slice.

    ``breaks[i]`` is the largest entry anchor that still leads to exit ``i``.
    """
    n = len(times)
    reach = _next_index(times, times[0], width, strict)
    firsts = np.flatnonzero(np.r_[True, times[1 : reach + 1] != times[: min(reach, n - 1)]])
    firsts = firsts[firsts < n]
    exits = firsts.copy()
    side = "right" if strict else "left"
    while True:
        ahead = np.searchsorted(times, times[exits] + width, side=side)
        moving = ahead < n
        if not moving.any():
            break
        exits = np.where(moving, np.minimum(ahead, n - 1), exits)
    # entry w leads to times[i] when times[i-1] fails the distance and times[i] meets it
    limit = times[firsts] - width - (1 if strict else 0)
    same = np.r_[exits[1:] == exits[:-1], False]
    return limit[~same], times[exits[~same]], (n - exits[~same]).astype(np.int64)


def with_entries(
    df: DataFrame,
    entries: DataFrame,
    group: list[str],
    order: list[str],
    fn: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table],
    added: list[T.StructField],
) -> DataFrame:
    """Rows of ``df`` with what ``fn(rows, starts, entry rows)`` adds to complete groups.

    ``entries`` has one row per group and travels with the rows as the first of its group, so
    they meet in one shuffle. ``fn`` gets the rows without it, and the entries in order of the groups.
    """
    extra = [f for f in entries.schema.fields if f.name not in group]
    first = "_is_row"
    both = df.withColumn(first, F.lit(1)).unionByName(
        entries.withColumn(first, F.lit(0)), allowMissingColumns=True
    )
    names = df.columns
    schema = T.StructType([*df.schema.fields, *added])

    def apply(table: pa.Table, starts: np.ndarray) -> pa.Table:
        lead = np.zeros(table.num_rows, dtype=bool)
        lead[starts] = True
        heads = table.filter(pa.array(lead)).select([f.name for f in extra])
        rows = table.filter(pa.array(~lead)).select(names)
        return fn(rows, starts - np.arange(len(starts)), heads)

    return map_sorted_groups(both, group, [first, *order], apply, schema)


def with_anchor(
    df: DataFrame,
    keys: list[str],
    time_us: str,
    order: list[str],
    width_us: int,
    strict: bool,
    eligible: str | None = None,
    slice_us: int = SLICE_US,
    chunk_rows: int = PART_ROWS,
    start: DataFrame | None = None,
) -> DataFrame:
    """Add ``anchor_before`` (time of the last anchor before the row, null if none),
    ``is_anchor`` and ``since_anchor`` (rows since the anchor, the anchor is row 1).

    ``time_us`` must not decrease along ``order``, whose first column is a unique sequence number.
    ``strict`` asks for a distance above ``width_us`` instead of at least. Only rows with a true
    ``eligible`` column can become anchors. ``start(*keys, anchor, rows)``: last anchor of a key
    before all rows and the number of rows since.
    """
    part = ["_slice", "_block"]
    df = df.withColumns({
        "_slice": F.floor(F.col(time_us) / F.lit(slice_us)),
        "_block": F.floor(F.col(order[0]) / F.lit(chunk_rows)),
    })
    key_fields = [df.schema[k] for k in keys]
    narrow = df.select(*keys, *part, time_us, *[o for o in order if o != time_us],
                       *([eligible] if eligible else []))

    def able(table: pa.Table) -> np.ndarray:
        if eligible is None:
            return np.ones(table.num_rows, dtype=bool)
        return np.asarray(table[eligible].to_numpy()).astype(bool)

    long = lambda name: T.StructField(name, T.LongType())
    #: one row without ``_break`` per part, with its number of rows, and one per step of its table
    step_schema = T.StructType([*key_fields, *map(long, [*part, "_break", "_exit", "_count"])])

    def summarize(table: pa.Table, starts: np.ndarray) -> pa.Table:
        times = table[time_us].to_numpy()
        ok = able(table)
        ends = np.r_[starts[1:], len(times)]
        at, breaks, exits, counts = [], [], [], []
        for a, b in zip(starts, ends):
            spots = np.flatnonzero(ok[a:b])
            lim = ex = np.empty(0, np.int64)
            if len(spots):
                t = times[a:b][spots]
                lim, ex, _ = _step_table(t, width_us, strict)
                counts.append(np.r_[b - a, (b - a) - spots[np.searchsorted(t, ex)]])
            else:
                counts.append(np.array([b - a]))
            at.append(np.full(len(lim) + 1, a))
            breaks.append(np.r_[_NONE, lim])
            exits.append(np.r_[_NONE, ex])
        breaks, exits = np.concatenate(breaks), np.concatenate(exits)
        picked = table.select([*keys, *part]).take(pa.array(np.concatenate(at)))
        return pa.table({
            **{c: picked[c] for c in picked.column_names},
            "_break": pa.array(breaks, pa.int64(), mask=breaks == _NONE),
            "_exit": pa.array(exits, pa.int64(), mask=exits == _NONE),
            "_count": pa.array(np.concatenate(counts), pa.int64()),
        })

    entry_schema = T.StructType([*key_fields, *map(long, [*part, "_entry", "_entry_rows"])])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # streams over steps; only the current key, its anchor and the part's row count are kept
        key, anchor, rows, waiting = None, _NONE, 0, 0
        for batch in batches:
            ids = list(zip(*[batch[k].to_pylist() for k in keys]))
            parts = batch["_block"].null_count and batch["_block"].is_null().to_numpy(zero_copy_only=False)
            heads = batch["_break"].is_null().to_numpy(zero_copy_only=False)
            breaks = batch["_break"].fill_null(_NONE).to_numpy()
            exits, counts = batch["_exit"].fill_null(_NONE).to_numpy(), batch["_count"].to_numpy()
            at, entry, entry_rows = [], [], []
            # rows at which a part begins, and the end
            marks = np.flatnonzero(heads)
            edges = [0, *marks.tolist(), len(heads)] if not len(marks) or marks[0] else [*marks.tolist(), len(heads)]
            for a, b in zip(edges, edges[1:]):
                if a < b and heads[a]:
                    rows += waiting
                    if ids[a] != key:
                        key, anchor, rows = ids[a], _NONE, 0
                    if isinstance(parts, np.ndarray) and parts[a]:  # what the key brings along
                        anchor, rows, waiting = exits[a], int(counts[a]), 0
                        continue
                    at.append(a)
                    entry.append(anchor)
                    entry_rows.append(rows)
                    waiting = int(counts[a])
                    a += 1
                if waiting and a < b:
                    i = a if anchor == _NONE else a + int(np.searchsorted(breaks[a:b], anchor, side="left"))
                    if i < b:
                        anchor, rows, waiting = exits[i], int(counts[i]), 0
            picked = batch.select([*keys, *part]).take(pa.array(at, pa.int64()))
            entry = np.array(entry, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*picked.columns, pa.array(entry, pa.int64(), mask=entry == _NONE), pa.array(entry_rows, pa.int64())],
                names=[*keys, *part, "_entry", "_entry_rows"],
            )

    steps = map_sorted_groups(narrow, [*keys, *part], order, summarize, step_schema)
    if start is not None:
        none = F.lit(None).cast("bigint")
        steps = steps.unionByName(start.select(
            *keys, none.alias("_slice"), none.alias("_block"), none.alias("_break"),
            F.col("anchor").alias("_exit"), F.col("rows").alias("_count"),
        ))
    entries = (
        steps.repartition(*keys)
        .sortWithinPartitions(*keys, *part, "_break")
        .mapInArrow(walk, entry_schema)
    )

    def mark(table: pa.Table, starts: np.ndarray, heads: pa.Table) -> pa.Table:
        times = table[time_us].to_numpy()
        ok = able(table)
        entry_col = heads["_entry"].fill_null(_NONE).to_numpy()
        rows_col = heads["_entry_rows"].to_numpy()
        n = len(times)
        before = np.empty(n, dtype=np.int64)
        is_anchor = np.zeros(n, dtype=bool)
        since = np.empty(n, dtype=np.int64)
        for k, (a, b) in enumerate(zip(starts, np.r_[starts[1:], n])):
            spots = np.flatnonzero(ok[a:b])
            t = times[a:b][spots]
            found, anchor = [], entry_col[k]
            i = _next_index(t, anchor, width_us, strict)
            while i < len(t):
                found.append(spots[i])
                i = _next_index(t, t[i], width_us, strict)
            position = np.arange(b - a)
            found = np.asarray(found, dtype=np.int64)
            anchor_times = np.r_[anchor, times[a:b][found]]
            before[a:b] = anchor_times[np.searchsorted(found, position, side="left")]
            is_anchor[a + found] = True
            at = np.searchsorted(found, position, side="right")
            base = np.r_[-rows_col[k], found]
            since[a:b] = position - base[at] + 1
        return (
            table.append_column("anchor_before", pa.array(before, mask=before == _NONE))
            .append_column("is_anchor", pa.array(is_anchor))
            .append_column("since_anchor", pa.array(since))
        )

    added = [long("anchor_before"), T.StructField("is_anchor", T.BooleanType()), long("since_anchor")]
    return with_entries(df, entries, [*keys, *part], order, mark, added).drop(*part)
