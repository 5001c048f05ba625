"""Gate of the link watch: repeat marks that a failed scan takes back, and a limit per device.

Events of a device are links or snippets seen and reports of failed scans (``failed``; ``arrival_seq`` is
that of the event that was sent to the scan). In order of time, a seen key is accepted if it has no mark
younger than ``ttl_us`` and the device has admissions left; it is marked at once. A report removes the
mark of its own event and no later one, so the key may be taken again; the admission stays used up. A
device's state is its live marks and admissions, which the limit bounds, not its rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.operators.admission import admission_step

#: order of the events of a device
ORDER = ["t_us", "arrival_seq", "position"]


class Gate:
    """State of one device, moved on event by event."""

    def __init__(self, ttl_us=600_000_000, limit=10, window_us=60_000_000, max_marks=None, known=None):
        self.ttl_us, self.limit, self.window_us, self.max_marks = ttl_us, limit, window_us, max_marks
        keys, times, seqs, recent = known or ([], [], [], [])
        self.marks = {k: (t, s) for k, t, s in zip(keys, times, seqs)}  # in order of time
        self.recent = deque(recent)

    def known(self) -> tuple:
        marks = self.marks.values()
        return list(self.marks), [t for t, _ in marks], [s for _, s in marks], list(self.recent)

    def see(self, key: str | None, now: int, seq: int) -> bool:
        key = (key or "").strip()
        mark = self.marks.get(key)
        if not key or (mark is not None and now - mark[0] < self.ttl_us):
            return False
        if not admission_step(self.recent, now, self.limit, self.window_us, False)[0]:
            return False
        self.marks.pop(key, None)
        self.marks[key] = (now, seq)
        oldest = lambda: next(iter(self.marks))
        while self.marks and now - self.marks[oldest()][0] > self.ttl_us:
            del self.marks[oldest()]
        if self.max_marks is not None and len(self.marks) > self.max_marks:
            del self.marks[oldest()]
        return True

    def report(self, key: str | None, seq: int) -> None:
        key = (key or "").strip()
        if key in self.marks and self.marks[key][1] == seq:
            del self.marks[key]

    def run(self, data: pd.DataFrame) -> list[bool]:
        """Whether each event of ``data``, in order, is accepted; reports and rows without time are not."""
        taken = []
        for key, now, seq, failed in zip(data["watch_key"], data["t_us"], data["arrival_seq"], data["failed"]):
            if failed is not None and failed:
                self.report(key, int(seq))
                taken.append(False)
            else:
                taken.append(bool(pd.notna(now)) and self.see(key, int(now), int(seq)))
        return taken


def failures(reports: DataFrame) -> DataFrame:
    """Reports ``device_id, arrival_seq, position, t_us, watch_key`` of failed scans as gate events; ``t_us`` is the time
    of the failure."""
    return reports.select("device_id", *ORDER, "watch_key", F.lit(True).alias("failed"))


def watch_gate(events: DataFrame, **limits) -> DataFrame:
    """Add ``accepted`` to the events of a table; extra columns pass through.

    A device without id never counts. Rows of one device go through one task as a stream, since each decision depends on the
    last one; devices share tasks, and what is held is the state of one device and one Arrow batch.
    """
    schema = T.StructType([*events.schema.fields, T.StructField("accepted", T.BooleanType())])

    def gate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        device, state = None, None
        for batch in batches:
            parts = []
            # the sort leaves the rows of a device together
            for name, part in batch.groupby("device_id", sort=False):
                if name != device:
                    device, state = name, Gate(**limits)
                parts.append(part.assign(accepted=state.run(part)))
            if parts:
                yield pd.concat(parts)

    has_id = events.where("device_id is not null")
    ordered = has_id.repartition("device_id").sortWithinPartitions("device_id", *ORDER)
    return ordered.mapInPandas(gate, schema).unionByName(
        events.where("device_id is null").withColumn("accepted", F.lit(False))
    )
