"""Life cycles and short-lived rows of live sessions as keyed state, with timers and time to live."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from callgrid.streaming.run import keyed

# fixed values: seconds that a live session may be idle and that one may drain, minutes that live rows stay, live rows of a session
IDLE_S, DRAIN_S, TTL_MIN, MAX_ROWS = 90, 7_260, 15, 500
#: From which states a move leads on.
MOVES = {"ACTIVITY": ("LIVE",), "DRAINING": ("LIVE",), "ENDED": ("DRAINING",), "INCOMPLETE": ("LIVE", "DRAINING")}
MOVE = "session_id {kind}, event_id long, us long, move string, outcome string, state string, generation long"


class Session(NamedTuple):
    """state, generation, and the time in microseconds from which idling, draining or keeping counts."""

    state: str
    generation: int
    since_us: int


class Limits(NamedTuple):
    """Seconds until a live, a draining and a finished session's time is up; None: never."""

    idle_s: int | None = IDLE_S
    drain_s: int | None = DRAIN_S
    keep_s: int | None = 900

    def deadline(self, s: Session) -> int | None:
        limit = self.idle_s if s.state == "LIVE" else self.drain_s if s.state == "DRAINING" else self.keep_s
        return None if limit is None else s.since_us + limit * 1_000_000


def moved(s: Session | None, us: int, move: str, generation: int | None) -> tuple[Session | None, str]:
    """The session after one event, and what became of the event: a start begins the next generation in any
    state; other events count for the generation they name (none: the present one) and the states that the
    life cycle allows."""
    if move == "START":
        return Session("LIVE", 1 if s is None else s.generation + 1, us), "APPLIED"
    if s is None:
        return None, "NO_SESSION"
    if generation is not None and generation != s.generation:
        return s, "STALE_GENERATION"
    if s.state not in MOVES.get(move, ()):
        return s, "NOT_ALLOWED"
    return Session("LIVE" if move == "ACTIVITY" else move, s.generation, us), "APPLIED"


def passed(s: Session | None, us: int, limits: Limits) -> Iterator[tuple[Session | None, int]]:
    """The changes that time alone makes before a moment: an active session becomes incomplete at its
    deadline, a finished one is forgotten."""
    while s is not None and (at := limits.deadline(s)) is not None and us > at:
        s = Session("INCOMPLETE", s.generation, at) if s.state in ("LIVE", "DRAINING") else None
        yield s, at


class Lifecycle(StatefulProcessor):
    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "state string, generation long, since_us long, timer_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, (s, timer) = [], self.read()
        for r in pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable").itertuples():
            us = int(r.us)
            for s, at in passed(s, us, self.limits):
                out += self.told(key, s, at)
            s, outcome = moved(s, us, r.move, None if pd.isna(r.generation) else int(r.generation))
            out.append((key[0], int(r.event_id), us, r.move, outcome, s.state if s else None, s.generation if s else None))
        self.write(s, timer)
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out, (s, timer) = [], self.read()
        for s, at in passed(s, expiredTimerInfo.getExpiryTimeInMs() * 1000, self.limits):
            out += self.told(key, s, at)
        self.write(s, None)
        yield self.frame(out)

    def close(self) -> None:
        pass

    def told(self, key, s: Session | None, at: int) -> list[tuple]:
        return [] if s is None else [(key[0], None, at, None, "TIMED_OUT", s.state, s.generation)]

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        rows = pd.DataFrame(out, columns=["session_id", "event_id", "us", "move", "outcome", "state", "generation"])
        return rows.astype({"event_id": "Int64", "us": "Int64", "generation": "Int64"})

    def read(self) -> tuple[Session | None, int | None]:
        if not self.session.exists():
            return None, None
        state, generation, since, timer = self.session.get()
        return Session(state, generation, since), timer

    def write(self, s: Session | None, timer: int | None) -> None:
        """Keeps the session and one timer, just after its deadline; a forgotten session leaves nothing."""
        deadline = None if s is None else self.limits.deadline(s)
        due = None if deadline is None else deadline // 1000 + 1
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        if s is None:
            self.session.clear()
        else:
            self.session.update((*s, due))


def lifecycle(events: DataFrame, limits: Limits = Limits(), late: str = "10 seconds") -> DataFrame:
    """events: session_id, ts, event_id, move (START, ACTIVITY, DRAINING, ENDED or INCOMPLETE) and generation
    (null: the present one). A row for each event, with its outcome (APPLIED, STALE_GENERATION, NOT_ALLOWED,
    NO_SESSION) and the session's state and generation after it; and a row without event for each session
    that its deadline ends (TIMED_OUT), as the watermark passes it. A batch's events are taken in order of
    time. Events without session, time or identifier are left out."""
    kind = events.schema["session_id"].dataType.simpleString()
    rows = events.filter("session_id is not null and ts is not null and event_id is not null").withWatermark("ts", late)
    rows = rows.select("session_id", "ts", F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"), "move", F.col("generation").cast("long").alias("generation"))
    return keyed(rows.groupBy("session_id"), Lifecycle(limits), MOVE.format(kind=kind), "EventTime")


ROW = "session_id {kind}, utterance_id string, start_ms long, text string, change string"


class LiveRows(StatefulProcessor):
    """The unexpired utterances of a session, in a map whose entries the state store itself lets go."""

    def __init__(self, ttl_ms: int, most: int):
        self.ttl_ms, self.most = ttl_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "utterance_id string", "start_ms long, text string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = {r.utterance_id: (int(r.start_ms), r.text) for r in pd.concat(list(rows)).sort_values("event_id", kind="stable").itertuples()}
        held = {k[0]: v[0] for k, v in self.rows.iterator()} | {k: v[0] for k, v in new.items()}
        kept = set(sorted(held, key=lambda k: (-held[k], [-ord(c) for c in k]))[: self.most]) if len(held) > self.most else held.keys()
        out = []
        for k, (start, text) in new.items():
            if k in kept:
                self.rows.updateValue((k,), (start, text))
                out.append((key[0], k, start, text, "KEPT"))
        for k in held.keys() - kept:
            if k not in new or self.rows.containsKey((k,)):
                self.rows.removeKey((k,))
            out.append((key[0], k, held[k], None, "TRUNCATED"))
        yield pd.DataFrame(out, columns=["session_id", "utterance_id", "start_ms", "text", "change"])

    def close(self) -> None:
        pass


def live_rows(utterances: DataFrame, ttl_s: float = TTL_MIN * 60, most: int = MAX_ROWS) -> DataFrame:
    """utterances: session_id, utterance_id, event_id, start_ms, text. The newest text of an utterance
    (largest event_id of a batch) replaces the one before and is kept ttl_s seconds longer, of the clock;
    beyond `most` rows of a session the latest by (start_ms, utterance_id) stay. A row for each change: KEPT
    or TRUNCATED. Expired entries go from the state without a row, and without input."""
    kind = utterances.schema["session_id"].dataType.simpleString()
    rows = utterances.filter("session_id is not null and utterance_id is not null and event_id is not null")
    rows = rows.select("session_id", F.col("utterance_id").cast("string").alias("utterance_id"), "event_id", F.coalesce(F.col("start_ms").cast("long"), F.lit(0)).alias("start_ms"), "text")
    return keyed(rows.groupBy("session_id"), LiveRows(int(ttl_s * 1000), most), ROW.format(kind=kind), "ProcessingTime")
