"""Live windows: overlapping assignment, provisional and final utterances, and alerts, with one small state a call."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from callgrid.operators.sentiment import COOLDOWN_MS, DROP, MIN_PROB, MIN_SAMPLES, WINDOW_MS

# fixed values: milliseconds of a window and from one to the next, and how far a segment's start may move
LENGTH_MS, STRIDE_MS, MATCH_MS = 4_000, 3_000, 1_000
UTTERANCE = "session string, id long, start_ms long, end_ms long, text string, is_final boolean"


def overlapping(frames: DataFrame) -> DataFrame:
    """frames: start_ms from the session's begin, and others. A row for each window that a frame starts in,
    with its window_ms."""
    rows = frames.withColumn("_w", F.window(F.timestamp_millis("start_ms"), f"{LENGTH_MS} milliseconds", f"{STRIDE_MS} milliseconds"))
    return rows.withColumn("window_ms", F.unix_millis("_w.start")).filter("window_ms >= 0").drop("_w")


def settle(pending: list[dict], next_id: int, window_ms: int | None, segments: list[tuple]) -> tuple[list[dict], int, list[tuple]]:
    """One window's segments (start_ms, end_ms, text) against what is pending. A segment continues the
    first pending one that overlaps it and starts near it, and that no other of this window has continued.
    Gives what stays pending, the next number, and what to tell: texts that are new or changed, and, once,
    those that no later window reaches. window_ms is null at the end of the session: all are final."""
    met = []
    for start, end, text in segments:
        same = next((p for p in pending if p not in met and abs(p["start"] - start) <= MATCH_MS and p["start"] < end and start < p["end"]), None)
        if same is None:
            same = {"id": (next_id := next_id + 1), "told": None}
            pending = [*pending, same]
        same.update(start=start, end=end, text=text)
        met.append(same)
    closed = [p for p in pending if window_ms is None or p["end"] <= window_ms + STRIDE_MS]
    changed = [p for p in met if p not in closed and p["told"] != p["text"]]
    for p in changed:
        p["told"] = p["text"]
    out = [(p["id"], p["start"], p["end"], p["text"], final) for group, final in ((changed, False), (closed, True)) for p in group]
    return [p for p in pending if p not in closed], next_id, out


def utterances(windows: DataFrame, idle_s: int | None = None) -> DataFrame:
    """windows: session, window_ms (null ends the session) and segments, an array of (start_ms, end_ms,
    text) in session time. Utterances as they become known: a row each time a text changes, and one final
    row. Windows of one batch are taken in order; a window that comes after a later one is dropped. A session's
    end removes its state; with idle_s, so does that time of the clock without windows, and what is pending is
    then final (such a query runs on and on)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, next_id, last = state.get if state.exists else ("[]", 0, -1)
        pending, out, ended = json.loads(held), [], False
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], *t) for t in settle(pending, next_id, None, [])[2]], columns=["session", "id", "start_ms", "end_ms", "text", "is_final"])
            return
        rows = pd.concat(list(batches)).sort_values("window_ms", na_position="last", kind="stable")
        for r in rows.itertuples():
            at = None if pd.isna(r.window_ms) else int(r.window_ms)
            if at is not None and at <= last:
                continue
            found = [(s["start_ms"], s["end_ms"], s["text"]) for s in (r.segments if r.segments is not None else [])]
            pending, next_id, told = settle(pending, next_id, at, found)
            last, ended = (last, True) if at is None else (at, ended)
            out += [(key[0], *t) for t in told]
        kept(state, ended, (json.dumps(pending), next_id, last), idle_s)
        yield pd.DataFrame(out, columns=["session", "id", "start_ms", "end_ms", "text", "is_final"])

    return windows.select("session", "window_ms", "segments").groupBy("session").applyInPandasWithState(step, UTTERANCE, "pending string, next_id long, last long", "append", _timeout(idle_s))


def kept(state: GroupState, ended: bool, value: tuple, idle_s: int | None) -> None:
    """Keeps a session's value until its end, or until it has been idle so long."""
    if ended:
        if state.exists:
            state.remove()
        return
    state.update(value)
    if idle_s is not None:
        state.setTimeoutDuration(idle_s * 1000)


def _timeout(idle_s: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_s is None else GroupStateTimeout.ProcessingTimeTimeout


def falls(before: list[str] | None, now: list[str]) -> bool:
    """Whether the mean score falls enough between two windows (n, sum of scores, sum of probabilities)."""
    if before is None:
        return False
    (n0, s0, p0), (n, s, p) = ([Decimal(x) for x in w] for w in (before, now))
    return n >= MIN_SAMPLES and n0 >= MIN_SAMPLES and s0 * n - s * n0 >= Decimal(DROP) * n * n0 and p + p0 >= Decimal(MIN_PROB) * (n + n0)


def alerts(signals: DataFrame, window_ms: int = WINDOW_MS, cooldown_ms: int = COOLDOWN_MS, idle_s: int | None = None) -> DataFrame:
    """signals: call_id, start_ms, score, prob (decimals or texts of them), ended. The alerts of
    ``sentiment.alerts`` as a stream: a window is judged once a later one has begun or the call has ended
    (a row with `ended`, whose other columns count for nothing); signals for a judged window are dropped. A
    call's end removes its state, and with idle_s so does that time of the clock without signals."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, judged, told = state.get if state.exists else ("{}", -1, None)
        windows, out = {int(k): v for k, v in json.loads(held).items()}, []
        rows = pd.concat(list(batches)).sort_values("start_ms", na_position="last", kind="stable")
        ended = bool(rows["ended"].fillna(False).any())
        for r in rows[~rows["ended"].fillna(False).astype(bool)].itertuples():
            w = int(r.start_ms) // window_ms
            if w > judged:
                n, s, p = windows.get(w, ["0", "0", "0"])
                windows[w] = [str(int(n) + 1), str(Decimal(s) + Decimal(str(r.score))), str(Decimal(p) + Decimal(str(r.prob)))]
        newest = max(windows, default=-1)
        for w in sorted(windows):
            if judged < w and (w < newest or ended):
                at = (w + 1) * window_ms
                if falls(windows.get(w - 1), windows[w]) and (told is None or at - told >= cooldown_ms):
                    told = at
                    out.append((key[0], at))
                judged = w
        windows = {w: v for w, v in windows.items() if w >= judged}
        kept(state, ended, (json.dumps(windows), judged, told), idle_s)
        yield pd.DataFrame(out, columns=["call_id", "alert_ms"])

    kind = signals.schema["call_id"].dataType.simpleString()
    rows = signals.select("call_id", "start_ms", F.col("score").cast("string").alias("score"), F.col("prob").cast("string").alias("prob"), "ended")
    return rows.groupBy("call_id").applyInPandasWithState(step, f"call_id {kind}, alert_ms long", "windows string, judged long, kept long", "append", _timeout(idle_s))
