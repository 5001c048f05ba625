"""Keyed state for live flows. Each processor follows the batch operator of the same rule.

Rows of a key arrive in micro-batches and are ordered by sequence number inside a
batch. State is small per key. Marks, admissions, window contents and votes are dropped by event time:
a timer fires once the watermark has passed the time from which the state can't matter
any more. Rows that come later than the watermark's ``delay`` are dropped by Spark.
Sender profiles are kept; they can start from a stored snapshot and be read back as one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskflow.operators.admission import admission_step
from riskflow.operators.sender_rules import HOUR_US, KEYS, SenderState, hour_mask, parse_sender
from riskflow.operators.watch import ORDER, Gate


def _ordered(rows: Iterator[pd.DataFrame], seq: str | list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(seq, kind="stable")


#: how far rows may lag behind the newest one before expiry may drop what they need
DELAY = "10 minutes"
#: event time after which an unseen window or vote counts as new
IDLE_US = 7 * 24 * 3600 * 1_000_000


def keyed(
    df: DataFrame,
    keys: list[str],
    processor: StatefulProcessor,
    added: str,
    initial: DataFrame | None = None,
    delay: str = DELAY,
) -> DataFrame:
    """Run a processor per key; the output is the input row plus ``added``.

    ``initial`` holds one row per key that was seen before the stream began. A processor that expires
    its state takes ``t_us`` of the rows as event time.
    """
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(added).fields])
    processor.columns, processor.keys = schema.names, keys
    mode = "None"
    if processor.expires:
        # the first watermark is the epoch, and rows at it would count as late
        event = F.timestamp_micros(F.greatest("t_us", F.lit(1)))
        df = df.withColumn("_event_time", event).withWatermark("_event_time", delay)
        mode = "EventTime"
    elif processor.ttl_ms is not None:
        mode = "ProcessingTime"
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=schema,
        outputMode="Append",
        timeMode=mode,
        initialState=None if initial is None else initial.groupBy(*keys),
    )


class _Keyed(StatefulProcessor):
    """One state value per key, updated row by row."""

    state_schema = ""
    seq: str | list[str] = "arrival_seq"
    columns: list[str] = []
    keys: list[str] = []
    #: whether event time drops the state of a key
    expires = False

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema, None if self.expires else self.ttl_ms)
        if self.expires:
            self.until = handle.getValueState("until", "until_ms bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.state.update(self.stored(initialState.iloc[0]))

    def stored(self, row: pd.Series) -> tuple:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        data = _ordered(rows, self.seq)
        known = self.state.get() if self.state.exists() else None
        out, new = self.step(data, known)
        if new is not None:
            self.state.update(new)
        if self.expires:
            self._keep(None if new is None else self.useful_until(new, data))
        # a derived key comes apart from the rows
        yield out.assign(**{k: v for k, v in zip(self.keys, key) if k not in out.columns})[self.columns]

    def _keep(self, until_us: int | None) -> None:
        """Move the key's timer to the first millisecond from which its state can't matter."""
        old = self.until.get()[0] if self.until.exists() else None
        new = None if until_us is None else until_us // 1000 + 1
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        if new is None:
            self.state.clear()
            self.until.clear()
        elif new != old:
            self.handle.registerTimer(new)
            self.until.update((new,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.until.exists() or self.until.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            self.until.clear()
        yield from ()

    def useful_until(self, new: tuple, data: pd.DataFrame) -> int | None:
        """Event time (microseconds) up to which ``new`` decides anything; none: not even now."""
        raise NotImplementedError

    def step(self, data: pd.DataFrame, known):
        raise NotImplementedError

    def close(self) -> None:
        pass


# ------------------------------------------------------------------ sender profiles
HISTORY = (
    "prior_count bigint, prior_last_us bigint, prior_links bigint, prior_files bigint,"
    " prior_domain string, prior_hours bigint, recent_count bigint, recent_start_us bigint"
)


class SenderProfile(_Keyed):
    state_schema = (
        "n bigint, last_us bigint, links bigint, files bigint, domain string, hours bigint,"
        " recent bigint, start_us bigint"
    )

    def step(self, data, known):
        n, last, links, files, domain, hours, recent, start = known or (0, 0, 0, 0, "", 0, 0, 0)
        found = []
        for row in data.itertuples():
            now, hour = row.t_us, int(row.hour)
            if n == 0:
                recent, start, prior = 1, now, (0, None, None, None, None, None)
            else:
                if now - start > HOUR_US:
                    recent, start = 0, now
                recent += 1
                prior = (n, last, links, files, domain, hours)
            found.append((*prior, recent, start))
            last = now if n == 0 else max(last, now)
            n, links, files = n + 1, links + int(row.has_link), files + int(row.has_file)
            domain, hours = row.domain, hours | (1 << hour)
        extra = pd.DataFrame(found, columns=[f.split()[0] for f in HISTORY.split(", ")], index=data.index)
        for name in extra.columns.difference(["prior_domain"]):
            extra[name] = extra[name].astype("Int64")
        return pd.concat([data, extra], axis=1), (
            n, int(last), links, files, domain, hours, recent, int(start)
        )

    def stored(self, row):
        return (
            int(row.message_count), int(row.last_seen_us), int(row.link_count), int(row.file_count),
            row.last_domain or "", int(row.hours), int(row.recent_count), int(row.recent_window_start_us),
        )


class NameDomain(_Keyed):
    """Domain first tied to a display name; kept when others use the name later."""

    state_schema = "domain string"

    def step(self, data, known):
        domain, found = (known[0] if known else None), []
        for row in data.itertuples():
            found.append(domain if row.display_name else None)
            if domain is None and row.display_name and row.domain:
                domain = row.domain
        return data.assign(name_domain=found), ((domain,) if domain else None)

    def stored(self, row):
        return (row.last_domain or None,)


def sender_history_stream(
    messages: DataFrame, ttl_ms: int | None = None, state: SenderState | None = None
) -> DataFrame:
    """Streaming form of the sender history; feed it to ``with_sender_signals``.

    ``state``: what the messages before the stream left, taken when the stream first starts.
    """
    df = parse_sender(messages).withColumn(
        "hour", F.pmod(F.floor(F.col("t_us") / F.lit(HOUR_US)), F.lit(24)).cast("int")
    )
    profiles = names = None
    if state is not None:
        profiles = state.profiles.withColumn("hours", hour_mask(state.profiles)).select(
            *KEYS, "message_count", "last_seen_us", "link_count", "file_count", "last_domain", "hours",
            "recent_count", "recent_window_start_us",
        )
        names = state.names.select("client_id", F.col("display_name").alias("_name_key"), "last_domain")
    df = keyed(df, KEYS, SenderProfile(ttl_ms), HISTORY, profiles)
    # mails without a name share no state, so they are dealt by sender
    nameless = F.concat(F.lit("<>"), "profile_key")
    df = df.withColumn("_name_key", F.when(F.col("display_name") == "", nameless).otherwise(F.col("display_name")))
    return keyed(
        df, ["client_id", "_name_key"], NameDomain(ttl_ms), "name_domain string", names,
    ).drop("_name_key")


def stream_sender_state(spark: SparkSession, checkpoint: str) -> SenderState:
    """State of a stream of :func:`sender_history_stream`, read from its checkpoint.

    Profiles have ``hours`` (a bit per hour) in place of counts per hour; both can be handed on.
    """
    def read(operator: int) -> DataFrame:
        return (
            spark.read.format("statestore").option("path", checkpoint).option("operatorId", operator)
            .option("stateVarName", "state").load()
        )

    def has(df: DataFrame, column: str) -> bool:
        return column in df.schema["value"].dataType.names

    first, second = read(0), read(1)
    profiles, names = (first, second) if has(first, "n") else (second, first)
    return SenderState(
        profiles.select(
            "key.client_id", "key.profile_key", F.col("value.n").alias("message_count"),
            F.col("value.links").alias("link_count"), F.col("value.files").alias("file_count"),
            F.col("value.last_us").alias("last_seen_us"), F.col("value.domain").alias("last_domain"),
            "value.hours", F.col("value.recent").alias("recent_count"),
            F.col("value.start_us").alias("recent_window_start_us"),
        ),
        names.select("key.client_id", F.col("key._name_key").alias("display_name"), F.col("value.domain").alias("last_domain")),
    )


# ------------------------------------------------------------------ repeats and admission
class TtlMark(_Keyed):
    """Suppress a key while its mark is young; failed scans leave no mark."""

    state_schema = "mark bigint"
    expires = True

    def useful_until(self, new, data):
        return None if new[0] is None else new[0] + self.ttl_us

    def __init__(self, ttl_us: int, succeeded: str | None, ttl_ms: int | None = None) -> None:
        super().__init__(ttl_ms)
        self.ttl_us, self.succeeded = ttl_us, succeeded

    def step(self, data, known):
        mark, accepted = (known[0] if known else None), []
        ok = data[self.succeeded] if self.succeeded else pd.Series(True, index=data.index)
        for now, good in zip(data["t_us"], ok):
            free = mark is None or now - mark >= self.ttl_us
            accepted.append(free)
            if free:
                mark = int(now) if good else None
        return data.assign(accepted=accepted), (mark,)


class Admission(_Keyed):
    """Sliding-window admission with at most ``limit`` remembered times."""

    state_schema = "times array<bigint>"
    expires = True

    def useful_until(self, new, data):
        return new[0][-1] + self.window_us if new[0] else None

    def __init__(self, limit: int, window_us: int, inclusive: bool, ttl_ms: int | None = None) -> None:
        super().__init__(ttl_ms)
        self.limit, self.window_us, self.inclusive = limit, window_us, inclusive

    def step(self, data, known):
        recent = deque(known[0] if known else [])
        found = [
            admission_step(recent, int(t), self.limit, self.window_us, self.inclusive)
            for t in data["t_us"]
        ]
        allowed, wait = zip(*found)
        return data.assign(allowed=allowed, retry_after=wait), (list(recent),)


class Debounce(_Keyed):
    """Flag rows whose content differs from the previous row of the key.

    A window unseen for ``idle_us`` of event time is forgotten, its next row counts as changed.
    """

    state_schema = "content string"
    expires = True

    def __init__(self, idle_us: int = IDLE_US, ttl_ms: int | None = None) -> None:
        super().__init__(ttl_ms)
        self.idle_us = idle_us

    def useful_until(self, new, data):
        return int(data["t_us"].max()) + self.idle_us

    def step(self, data, known):
        before = [known[0] if known else None, *data["content"].tolist()[:-1]]
        changed = [b is None or b != c for b, c in zip(before, data["content"])]
        return data.assign(changed=changed), (data["content"].iloc[-1],)


class FirstVote(_Keyed):
    """Flag the first vote of a scan; one that is ``idle_us`` of event time old is forgotten."""

    state_schema = "seen boolean"
    expires = True

    def __init__(self, idle_us: int = IDLE_US, ttl_ms: int | None = None) -> None:
        super().__init__(ttl_ms)
        self.idle_us = idle_us

    def useful_until(self, new, data):
        return int(data["t_us"].max()) + self.idle_us

    def step(self, data, known):
        first = [known is None] + [False] * (len(data) - 1)
        return data.assign(inserted=first), (True,)


class WatchGate(_Keyed):
    """:class:`riskflow.operators.watch.Gate` of one device over the events of a stream.

    State goes when the last mark is ``ttl_us`` old and the last admission has left its window.
    """

    state_schema = "keys array<string>, marks array<bigint>, seqs array<bigint>, times array<bigint>"
    seq = ORDER
    expires = True

    def __init__(self, ttl_us=600_000_000, limit=10, window_us=60_000_000, max_marks=None, ttl_ms=None):
        super().__init__(ttl_ms)
        self.limits = {"ttl_us": ttl_us, "limit": limit, "window_us": window_us, "max_marks": max_marks}

    def useful_until(self, new, data):
        ends = [t + self.limits["ttl_us"] for t in new[1]] + [t + self.limits["window_us"] for t in new[3][-1:]]
        return max(ends, default=None)

    def step(self, data, known):
        gate = Gate(**self.limits, known=known)
        return data.assign(accepted=gate.run(data)), gate.known()


def ttl_dedup_stream(df, key, ttl_us=600_000_000, succeeded=None, delay=DELAY) -> DataFrame:
    return keyed(df, [key], TtlMark(ttl_us, succeeded), "accepted boolean", delay=delay)


def admit_stream(df, keys, limit=30, window_us=60_000_000, inclusive=True, delay=DELAY) -> DataFrame:
    return keyed(
        df, keys, Admission(limit, window_us, inclusive), "allowed boolean, retry_after bigint", delay=delay
    )


def debounce_stream(df, window, idle_us=IDLE_US, delay=DELAY) -> DataFrame:
    return keyed(df, [window], Debounce(idle_us), "changed boolean", delay=delay).where("changed").drop("changed")


def first_votes_stream(df, idle_us=IDLE_US, delay=DELAY) -> DataFrame:
    return keyed(df, ["scan_id"], FirstVote(idle_us), "inserted boolean", delay=delay)
