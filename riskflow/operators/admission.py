"""Sliding-window admission (server and client form) over a table of events.

With ``limit`` L an event is admitted if fewer than L of the admitted ones lie in its window, that is
if the L-th last admitted one has left it. So the next admission is found by a jump: the first event whose time
reaches that one's end. Every key is cut into blocks of sequence numbers:

1. per block: its times, sorted and packed;
2. per key: a walk over the packed times that jumps from admission to admission and notes the
   last L admitted times at the entry of each block (work per admission, not per event);
3. per block: decisions and waiting times of all events, now that its entry is known.

A busy stretch of one key thus spreads over tasks; only its times, eight bytes each, are streamed by one.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.operators.anchors import PART_ROWS, map_sorted_groups, with_entries
from riskflow.session import cut

#: times packed into one row of the walk
PIECE = 1000


def admission_step(
    recent: deque, now: int, limit: int, window_us: int, inclusive: bool
) -> tuple[bool, int]:
    """Admit or deny one event; ``recent`` holds the admitted times still inside the window.

    ``inclusive`` evicts a time exactly one window old (server form); the client form
    keeps it. Returns (allowed, seconds to wait).
    """
    while recent and (
        now - recent[0] >= window_us if inclusive else now - recent[0] > window_us
    ):
        recent.popleft()
    if len(recent) >= limit:
        return False, max(1, math.ceil((recent[0] + window_us - now) / 1_000_000))
    recent.append(now)
    return True, 0


def jump(times, at: int, recent: deque, window_us: int, inclusive: bool) -> int:
    """Next admitted position at or after ``at``; ``recent`` holds the last admitted times (at most its ``maxlen``)."""
    if len(recent) < recent.maxlen:
        return at
    find = bisect_left if inclusive else bisect_right
    return find(times, recent[0] + window_us, at)


def admit(
    df: DataFrame,
    keys: list[str],
    time_us: str,
    seq: str,
    limit: int = 30,
    window_us: int = 60_000_000,
    inclusive: bool = True,
    chunk_rows: int = PART_ROWS,
    start: DataFrame | None = None,
) -> DataFrame:
    """Add ``allowed`` and ``retry_after``; times must not decrease along ``seq``, which is unique.

    ``start(*keys, recent array<bigint>)``: last admitted times of a key before all rows, ascending.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    block = "_block"
    df = df.withColumn(block, F.floor(F.col(seq) / F.lit(chunk_rows)))
    key_fields = [df.schema[k] for k in keys]
    long_list = T.ArrayType(T.LongType())
    group = [*keys, block]

    def pack(table: pa.Table, starts: np.ndarray) -> pa.Table:
        times = table[time_us].to_numpy()
        ends = np.r_[starts[1:], len(times)]
        cuts = [(a, p, min(p + PIECE, b)) for a, b in zip(starts, ends) for p in range(a, b, PIECE)]
        picked = table.select(group).take(pa.array([a for a, _, _ in cuts]))
        offsets = pa.array([p for _, p, _ in cuts] + [len(times)], pa.int32())
        return pa.table({
            **{c: picked[c] for c in group},
            "_piece": pa.array([p - a for a, p, _ in cuts], pa.int64()),
            "_times": pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
        })

    packed_schema = T.StructType([
        *key_fields, T.StructField(block, T.LongType()), T.StructField("_piece", T.LongType()),
        T.StructField("_times", long_list),
    ])
    packed = map_sorted_groups(df.select(*group, seq, time_us), group, [seq], pack, packed_schema)
    if start is not None:
        none = F.lit(None).cast("bigint")
        packed = packed.unionByName(
            start.select(*keys, none.alias(block), none.alias("_piece"), F.col("recent").alias("_times"))
        )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, recent = None, deque(maxlen=limit)
        for batch in batches:
            at, entry = [], []
            ids = zip(*[batch[k].to_pylist() for k in keys])
            for i, (this, where, piece) in enumerate(zip(ids, batch[block].to_pylist(), batch["_piece"].to_pylist())):
                times = batch["_times"][i].values.to_numpy().tolist()
                if this != key:
                    key, recent = this, deque(maxlen=limit)
                if where is None:
                    recent.extend(times)
                    continue
                if piece == 0:
                    at.append(i)
                    entry.append(list(recent))
                spot = jump(times, 0, recent, window_us, inclusive)
                while spot < len(times):
                    recent.append(times[spot])
                    spot = jump(times, spot + 1, recent, window_us, inclusive)
            picked = batch.select(group).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*picked.columns, pa.array(entry, pa.list_(pa.int64()))], names=[*group, "_recent"]
            )

    entry_schema = T.StructType([*key_fields, T.StructField(block, T.LongType()), T.StructField("_recent", long_list)])
    entries = packed.repartition(*keys).sortWithinPartitions(*group, "_piece").mapInArrow(walk, entry_schema)

    def decide(table: pa.Table, starts: np.ndarray, heads: pa.Table) -> pa.Table:
        times = table[time_us].to_numpy()
        allowed, wait = np.zeros(len(times), bool), np.zeros(len(times), np.int64)
        for before, a, b in zip(heads["_recent"].to_pylist(), starts, np.r_[starts[1:], len(times)]):
            own, recent, taken = times[a:b].tolist(), deque(before, maxlen=limit), []
            spot = jump(own, 0, recent, window_us, inclusive)
            while spot < len(own):
                taken.append(spot)
                recent.append(own[spot])
                spot = jump(own, spot + 1, recent, window_us, inclusive)
            allowed[a + np.array(taken, np.int64)] = True
            admitted = np.r_[np.array(before, np.int64), times[a:b][taken]]
            refused = np.flatnonzero(~allowed[a:b])
            # the admitted event whose end the refused one has to wait for
            oldest = len(before) + np.searchsorted(taken, refused) - limit
            left = admitted[oldest] + window_us - times[a:b][refused]
            wait[a + refused] = np.maximum(1, -(-left // 1_000_000))
        return table.append_column("allowed", pa.array(allowed)).append_column("retry_after", pa.array(wait))

    added = [T.StructField("allowed", T.BooleanType()), T.StructField("retry_after", T.LongType())]
    return with_entries(df, entries, group, [seq], decide, added).drop(block)


def admit_request(
    df: DataFrame, ip: str, api_key: str, time_us: str, seq: str, **limits
) -> DataFrame:
    """Two admissions in a row: by address, then by key for what the address let through.

    The charge to the address stays when the key denies. ``allowed`` needs both.
    """
    by_ip = admit(df, [ip], time_us, seq, **limits).withColumnsRenamed(
        {"allowed": "ip_allowed", "retry_after": "ip_retry_after"}
    )
    by_ip = cut(by_ip)
    passed = admit(by_ip.where("ip_allowed"), [api_key], time_us, seq, **limits)
    denied = by_ip.where("not ip_allowed").withColumns(
        {"allowed": F.lit(False), "retry_after": F.col("ip_retry_after")}
    )
    return passed.unionByName(denied).drop("ip_allowed", "ip_retry_after")
