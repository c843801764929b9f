"""Media sessions from raw lines: text to parsed envelopes to one ordered state machine a call."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from callgrid.operators.media import MAX_MS, MAX_STREAM_BYTES, session_lines
from callgrid.streaming.run import keyed

# fixed values: bytes of a millisecond, seconds without a line
BYTES_PER_MS, IDLE_S = 16, 30
HELD = ["generation", "connected", "started", "stopped", "stream", "sequence", "chunk", "offset_ms", "bytes"]
STATE = "generation long, connected boolean, started boolean, stopped boolean, stream string, sequence long, chunk long, offset_ms long, bytes long, timer_ms long"
RESULT = "account_id string, call_id string, arrival long, kind string, status string, sequence long, chunk long, offset_ms long, n_bytes long, first_missing long, last_missing long, first_missing_chunk long, last_missing_chunk long"
RESULT_COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
#: Faults of a parsed envelope that count once the order of kinds is right.
OUTER = ("TOO_LARGE", "NOT_JSON")


def fresh(generation: int) -> dict[str, Any]:
    return {"generation": generation, "connected": False, "started": False, "stopped": False, "stream": None, "sequence": 0, "chunk": 0, "offset_ms": -1, "bytes": 0}


def judged(s: dict[str, Any], account: str, call: str, r: Any) -> str:
    """What is wrong with the next line of a session, or OK. The first rule that a line breaks names it; a
    line that breaks one changes nothing."""
    if r.generation != s["generation"]:
        return "STALE_GENERATION"
    if s["stopped"]:
        return "CLOSED"
    if r.fault in OUTER:
        return r.fault
    if r.kind == "connected":
        return "CONNECTED" if s["connected"] or s["started"] or not r.own_fields else "OK"
    if not s["connected"]:
        return "NOT_CONNECTED"
    if r.fault == "KIND":
        return "KIND"
    if pd.isna(r.sequence) or r.fault == "SEQUENCE":
        return "SEQUENCE"
    if r.sequence <= s["sequence"]:
        return "LATE"
    if r.kind == "start":
        if s["started"] or not r.own_fields:
            return "START"
        if (r.session, r.account, r.call) != (r.inner_session, account, call):
            return "IDENTITY"
        return r.start_fault or "OK"
    if not s["started"]:
        return "NOT_STARTED"
    if r.session != s["stream"]:
        return "STREAM"
    if not r.own_fields:
        return "FIELDS"
    if r.kind == "stop":
        return "OK" if (r.account, r.call) == (account, call) else "IDENTITY"
    if r.fault == "FIELDS":
        return "FIELDS"
    if r.fault == "CHUNK" or not r.numbered_chunk or r.chunk <= s["chunk"]:
        return "CHUNK"
    if r.fault == "TIMESTAMP" or r.offset_ms < s["offset_ms"]:
        return "TIMESTAMP"
    if r.fault == "PAYLOAD":
        return "PAYLOAD"
    if r.offset_ms * BYTES_PER_MS + r.n_bytes > MAX_MS * BYTES_PER_MS:
        return "DURATION"
    return "STREAM_BYTES" if s["bytes"] + r.n_bytes > MAX_STREAM_BYTES else "OK"


def accepted(s: dict[str, Any], r: Any) -> tuple[int | None, ...]:
    """Moves the session on by a good line, and gives the ranges of numbers missing before it."""
    if r.kind == "connected":
        s["connected"] = True
        return None, None, None, None
    gap = (s["sequence"] + 1, int(r.sequence) - 1) if r.sequence > s["sequence"] + 1 else (None, None)
    s["sequence"] = int(r.sequence)
    if r.kind == "start":
        s["started"], s["stream"] = True, r.session
    elif r.kind == "stop":
        s["stopped"] = True
    else:
        chunks = (s["chunk"] + 1, int(r.chunk) - 1) if r.chunk > s["chunk"] + 1 else (None, None)
        s["chunk"], s["offset_ms"], s["bytes"] = int(r.chunk), int(r.offset_ms), s["bytes"] + int(r.n_bytes)
        return *gap, *chunks
    return *gap, None, None


class MediaSession(StatefulProcessor):
    def __init__(self, idle_s: int | None):
        self.idle_s = idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("session", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        *values, timer = self.held.get() if self.held.exists() else (None,) * (len(HELD) + 1)
        s, out, last = dict(zip(HELD, values)) if values[0] is not None else None, [], 0
        for r in pd.concat(list(rows)).sort_values("arrival", kind="stable").itertuples():
            last = max(last, int(r.ms))
            if s is None or r.generation > s["generation"]:  # the call's stream begins anew
                s = fresh(int(r.generation))
            status = judged(s, key[0], key[1], r)
            missing = accepted(s, r) if status == "OK" else (None,) * 4
            out.append((*key, r.arrival, r.kind, status, r.sequence, r.chunk, r.offset_ms, r.n_bytes, *missing))
        if self.idle_s is not None:
            due = last + self.idle_s * 1000 + 1
            if timer is None or due > timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timer := due)
        self.held.update((*s.values(), timer))
        yield table(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        stopped = self.held.exists() and self.held.get()[HELD.index("stopped")]
        self.held.clear()
        yield table([] if stopped else [(*key, None, None, "ABANDONED", *(None,) * 8)])

    def close(self) -> None:
        pass


def table(out: list[tuple]) -> pd.DataFrame:
    rows = pd.DataFrame(out, columns=RESULT_COLUMNS)
    return rows.astype({c: "Int64" for c in RESULT_COLUMNS if c not in ("account_id", "call_id", "kind", "status")})


def media_sessions(lines: DataFrame, idle_s: int | None = IDLE_S, late: str = "10 seconds") -> DataFrame:
    """lines: account_id, call_id, generation (what is trusted about the connection), ts, arrival (the
    line's number on the connection) and value (the line). A row for each line: status OK or the rule it
    breaks (late and repeated ones are errors, never reordered), the numbers it bears, and the ranges of
    sequence and chunk numbers missing before it; a jump costs two numbers, however far it goes. A session
    without lines for idle_s seconds is forgotten, with a row ABANDONED if it had not stopped. A batch's
    lines are taken by arrival. Lines without account, call, generation, time or arrival are left out."""
    whole = " and ".join(f"{c} is not null" for c in ("account_id", "call_id", "generation", "ts", "arrival"))
    rows = session_lines(lines.filter(whole).select("account_id", "call_id", F.col("generation").cast("long").alias("generation"), "ts", F.unix_millis("ts").alias("ms"), F.col("arrival").cast("long").alias("arrival"), F.coalesce("value", F.lit("")).alias("value"))).drop("value")
    return keyed(rows.withWatermark("ts", late).groupBy("account_id", "call_id"), MediaSession(idle_s), RESULT, "EventTime")
