"""Keyed state: message reassembly, conversation histories, sessions.

Messages of one key may arrive in any order and in different micro-batches. Every
operator here therefore holds events back until the watermark has passed them and
then applies them in event-time order; what it emits does not depend on how the
input was cut into batches.

An event of a message or conversation waits as one entry of a map state under its time and its number within that
time, with a timer for the time. Timers of a key fire in time order, so an event is
written once, read once and removed. What a key carries on is typed state as well: values, and maps
whose entries are single chunks or turns. Keys are forgotten by a timer in event time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threadmine.functions.times import CONNECTION_DAYS, SESSION_DAYS
from threadmine.operators.conversation import CHAT_TAIL

DAY_MS = 86_400_000

# A Python process beside the driver's JVM opens the state of a processor first. What ``addPyFile`` sends reaches the
# executors only, so the classes below travel by value and nobody has to import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _InOrder(StatefulProcessor):
    """Hands each event of a key to ``apply`` once the watermark has passed it, in the order of time and ``seq``.

    ``fields``: name and type of the columns of an event besides ``ms`` and ``seq``. Subclasses keep ``last_ms``, the
    time of the last event that the key must be remembered for, by calling ``remember``; ``forget`` clears their state.
    """

    fields: list[tuple[str, str]] = []
    output: list[str] = []

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        columns = ", ".join(f"{name} {kind}" for name, kind in [("seq", "bigint"), *self.fields])
        self.waiting = handle.getMapState("waiting", "ms bigint, n int", columns)
        self.numbers = handle.getMapState("numbers", "ms bigint", "n int")
        self.last = handle.getValueState("last", "ms bigint")
        self.open()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for ms, events in batch.groupby("ms", sort=False):
                ms = int(ms)
                held = self.numbers.getValue((ms,))
                n = held[0] if held else 0
                for event in events[["seq", *(name for name, _ in self.fields)]].astype(object).itertuples(index=False):
                    self.waiting.updateValue((ms, n), tuple(None if pd.isna(x) else x for x in event))
                    n += 1
                self.numbers.updateValue((ms,), (n,))
                if not held:
                    self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        held = self.numbers.getValue((ms,))
        events = []
        for n in range(held[0] if held else 0):
            events.append(self.waiting.getValue((ms, n)))
            self.waiting.removeKey((ms, n))
        if held:
            self.numbers.removeKey((ms,))
        last = self.last.get() if self.last.exists() else None
        if last is not None and ms > last[0] + self.keep_ms:
            self.last.clear()
            self.forget()
        rows = []
        for event in sorted(events, key=lambda e: e[0]):
            rows += self.apply(key[0], ms, *event)
        if rows:
            yield pd.DataFrame(rows, columns=self.output)

    def remember(self, ms: int) -> None:
        """The key is forgotten when ``keep_ms`` have passed after ``ms``."""
        self.unset_expiry()
        self.last.update((ms,))
        self.handle.registerTimer(ms + self.keep_ms + 1)

    def unset_expiry(self) -> None:
        if self.last.exists():
            at = self.last.get()[0] + self.keep_ms + 1
            if not self.numbers.containsKey((at,)):  # else events wait for the same time
                self.handle.deleteTimer(at)
            self.last.clear()

    def close(self) -> None:
        pass


def _applied(events: DataFrame, key: str, delay: str, processor: _InOrder, output: str) -> DataFrame:
    """``events`` has ``ts`` and ``seq`` (order within a time)."""
    stamped = events.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts")).select(
        key, "ts", "ms", F.col("seq").cast("bigint").alias("seq"), *[name for name, _ in processor.fields])
    return stamped.groupBy(key).transformWithStateInPandas(processor, output, "Append", "EventTime")


# -- response pieces ---------------------------------------------------------

class _Reassembly(_InOrder):
    fields = [("type", "string"), ("content", "string")]
    output = ["message_id", "n_chunks", "content"]

    def open(self) -> None:
        self.chunks = self.handle.getMapState("chunks", "seq bigint", "content string")
        self.ends = self.handle.getValueState("ends", "started boolean, stop bigint, n bigint")

    def forget(self) -> None:
        self.chunks.clear()
        self.ends.clear()

    def apply(self, key: str, ms: int, seq: int, kind: str, content: str | None) -> list[tuple]:
        started, stop, n = self.ends.get() if self.ends.exists() else (False, None, 0)
        if kind == "message_start":
            started = True
        elif kind == "message_chunk":
            n += not self.chunks.containsKey((seq,))
            self.chunks.updateValue((seq,), (content or "",))
        elif kind == "message_end":
            stop = seq
        # seq counts from 0 at the start, so the end tells how many pieces lie between.
        if started and stop is not None and n >= stop - 1:
            parts = sorted((k[0], v[0]) for k, v in self.chunks.iterator())
            self.unset_expiry()
            self.forget()
            return [(key, len(parts), "".join(text for _, text in parts))]
        self.ends.update((started, stop, n))
        self.remember(ms)
        return []


def reassemble_stream(events: DataFrame, delay: str = "10 minutes", keep_days: int = 1) -> DataFrame:
    """Texts of the messages that are complete: ``(message_id, n_chunks, content)``.

    ``events`` is ``(message_id, type, seq, content, ts)``. A message of which no piece has come for
    ``keep_days`` is forgotten.
    """
    return _applied(events, "message_id", delay, _Reassembly(keep_days * DAY_MS), "message_id string, n_chunks bigint, content string")


# -- conversation histories --------------------------------------------------

class _History(_InOrder):
    fields = [("role", "string"), ("content", "string")]
    output = ["connection_id", "seq", "n_turns", "n_kept", "roles"]

    def __init__(self, keep_ms: int, tail: int):
        super().__init__(keep_ms)
        self.tail = tail

    def open(self) -> None:
        self.turns = self.handle.getMapState("turns", "n bigint", "role string, content string")
        self.roles = self.handle.getValueState("roles", "n bigint, roles string")

    def forget(self) -> None:
        self.turns.clear()
        self.roles.clear()

    def apply(self, key: str, ms: int, seq: int, role: str | None, content: str | None) -> list[tuple]:
        if role == "disconnect":
            self.unset_expiry()
            self.forget()
            return []
        n, roles = self.roles.get() if self.roles.exists() else (0, "")
        n, kept = n + 1, [*(roles.split(",") if n else []), role or ""]
        self.turns.updateValue((n,), (role, content))
        if len(kept) > self.tail + 1:  # the first turn and the last ones stay
            self.turns.removeKey((n - self.tail,))
            del kept[1]
        self.roles.update((n, ",".join(kept)))
        self.remember(ms)
        return [(key, seq, n, len(kept), ",".join(kept))]


def conversation_stream(
    turns: DataFrame, delay: str = "10 minutes", tail: int = CHAT_TAIL, keep_days: int = CONNECTION_DAYS
) -> DataFrame:
    """History of each connection after each turn: first turn and last ``tail`` kept.

    ``turns`` is ``(connection_id, seq, role, content, ts)``; the role ``disconnect`` ends the connection, and so do
    ``keep_days`` without a turn.
    """
    return _applied(turns, "connection_id", delay, _History(keep_days * DAY_MS, tail),
                    "connection_id string, seq bigint, n_turns bigint, n_kept bigint, roles string")


# -- sessions ----------------------------------------------------------------
#
# A request costs too little work for state of its own. Sessions are therefore dealt to a fixed number of groups, and
# a group's requests are held back, put in order and classified all at once. State is appended: a row of arrays for the
# requests of a group in a micro-batch, and one for the sessions that they changed.

SESSION_GROUPS = 256
# Rows of sessions in a group that are outdated, besides as many as are not, before the state is written anew.
_OUTDATED = 1_000


class _Session(StatefulProcessor):
    """State: ``waiting`` requests, ``sessions`` that live (of a session's rows the last counts), and the time of the timer
    that forgets the ones that have run out."""

    columns = ["session_id", "ms", "seq", "unnumbered", "create"]
    output = ["session_id", "seq", "status", "created_ms"]

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState(
            "waiting", "session_id array<string>, ms array<bigint>, seq array<bigint>, unnumbered array<boolean>, create array<boolean>")
        self.sessions = handle.getListState("sessions", "session_id array<string>, created array<bigint>, last array<bigint>")
        self.due = handle.getValueState("due", "ms bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            if len(batch):
                self.waiting.appendValue(_row(batch[c] for c in self.columns))
                low = int(batch["ms"].min())
                first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(first + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Requests before the watermark are final: a later one would come late."""
        now, at = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        due = self.due.get()[0] if self.due.exists() else None
        if due == at:
            self.due.clear()
        held = list(self.waiting.get())
        requests = pd.DataFrame({c: _joined(x[i] for x in held) for i, c in enumerate(self.columns)})
        ready = requests["ms"] < now
        if not ready.any() and due != at:
            return
        rest = requests[~ready]
        self.waiting.clear()
        if len(rest):
            self.waiting.appendValue(_row(rest[c] for c in self.columns))
            self.handle.registerTimer(int(rest["ms"].min()) + 1)
        stored = list(self.sessions.get())
        known = pd.DataFrame({c: _joined(x[i] for x in stored) for i, c in enumerate(["session_id", "created", "last"])})
        n_stored = len(known)
        known = known.drop_duplicates("session_id", keep="last")
        rows, changed = classified(requests[ready], known, self.keep_ms)
        every = pd.concat([known[~known["session_id"].isin(changed["session_id"])], changed]) if len(changed) else known
        every, changed = (x[x["last"] + self.keep_ms >= now] for x in (every, changed))  # requests that wait are not older
        if n_stored + len(changed) > 2 * len(every) + _OUTDATED or len(stored) > 16 or not len(every):
            self.sessions.clear()
            changed = every
        if len(changed):
            self.sessions.appendValue(_row(changed[c] for c in ["session_id", "created", "last"]))
        if len(every) and (due is None or due == at):
            runs_out = int(every["last"].min()) + self.keep_ms + 1
            self.due.update((runs_out,))
            self.handle.registerTimer(runs_out)
        if len(rows):
            yield rows

    def close(self) -> None:
        pass


def _row(columns: Iterator[pd.Series]) -> tuple:
    """Columns as arrays of one row. Only ids may be null."""
    return tuple([None if pd.isna(x) else x for x in c] if c.dtype == object else c.tolist() for c in columns)


def _joined(lists: Iterator[list]) -> pd.Series:
    values = [x for part in lists for x in part]
    return pd.Series(values, dtype=object if None in values or not values or isinstance(values[0], str) else None)


def classified(requests: pd.DataFrame, known: pd.DataFrame, keep_ms: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Status and start of the session for each request, and the sessions ``(session_id, created, last)`` after them.

    ``requests`` is ``(session_id, ms, seq, unnumbered, create)`` in any order, ``known`` the sessions before them. Requests of a
    session with no pause longer than ``keep_ms`` between them are one run, and in a run all after its first creation
    are accepted: see ``conversation.session_fold``. A known session is a creation at its last time.
    """
    n, m = len(known), len(requests)
    name = np.concatenate([known["session_id"].to_numpy(object), requests["session_id"].to_numpy(object)])
    codes, names = pd.factorize(name, use_na_sentinel=False)
    ms = np.concatenate([known["last"].to_numpy(np.int64), requests["ms"].to_numpy(np.int64)])
    start = np.concatenate([known["created"].to_numpy(np.int64), requests["ms"].to_numpy(np.int64)])
    create = np.concatenate([np.ones(n, bool), requests["create"].to_numpy(bool)])
    fresh = np.arange(n + m) >= n
    seq = np.concatenate([np.zeros(n, np.int64), requests["seq"].to_numpy(np.int64)])
    empty = np.concatenate([np.zeros(n, bool), requests["unnumbered"].to_numpy(bool)])
    order = np.lexsort((seq, empty, fresh, ms, codes))
    codes, ms, start, create, fresh = codes[order], ms[order], start[order], create[order], fresh[order]
    opens = np.ones(n + m, bool)  # the first of a run
    opens[1:] = (codes[1:] != codes[:-1]) | (ms[1:] - ms[:-1] > keep_ms)
    run = np.cumsum(opens) - 1
    place = np.arange(n + m)
    first = np.full(run[-1] + 1 if n + m else 0, n + m)
    np.minimum.at(first, run[create], place[create])
    lives = place >= first[run]
    created = start[np.minimum(first[run], n + m - 1)] if n + m else start
    status = np.where(create, "new", np.where(lives, "valid", "invalid"))
    ids = np.asarray(names, object)[codes]
    out = pd.DataFrame({"session_id": ids, "seq": pd.array(seq[order], "Int64"), "status": status, "created_ms": pd.array(created, "Int64")})
    out.loc[empty[order], "seq"] = pd.NA
    out.loc[~lives, "created_ms"] = pd.NA
    ends = np.append(codes[1:] != codes[:-1], True) & lives if n + m else lives
    after = pd.DataFrame({"session_id": ids[ends], "created": created[ends], "last": ms[ends]})
    touched = np.isin(codes[ends], codes[fresh])
    return out[fresh], after[touched]


def session_stream(
    requests: DataFrame, delay: str = "10 minutes", keep_days: int = SESSION_DAYS, groups: int = SESSION_GROUPS
) -> DataFrame:
    """Status of each request of a session: new, valid or invalid; the batch form is ``conversation.session_fold``.

    ``requests`` is ``(session_id, seq, kind, ts)``, kind ``create`` or ``touch``. Every accepted
    request moves the expiry on. A task holds the waiting requests and living sessions of one of ``groups`` groups at a
    time; their number belongs to the state and can't change while a checkpoint is used.
    """
    stamped = requests.withWatermark("ts", delay).where(F.col("ts").isNotNull()).select(
        F.pmod(F.xxhash64("session_id"), F.lit(groups)).alias("group"), "ts", "session_id", F.unix_millis("ts").alias("ms"),
        F.coalesce(F.col("seq").cast("bigint"), F.lit(0)).alias("seq"), F.col("seq").isNull().alias("unnumbered"), F.coalesce(F.col("kind") == "create", F.lit(False)).alias("create"))
    return stamped.groupBy("group").transformWithStateInPandas(
        _Session(keep_days * DAY_MS), "session_id string, seq bigint, status string, created_ms bigint", "Append", "EventTime")
