"""Media frames of live calls as a stream: order, gaps and ceilings, one small state for each session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# fixed values: most bytes of a session, bytes of a millisecond, seconds without a frame
MAX_BYTES, BYTES_PER_MS, IDLE_S = 100_000_000, 16, 30
RESULT = "session string, sequence long, status string, missing array<long>, first_missing long, last_missing long, at_ms long"
LISTED, MAX_SEQUENCE = 1_000, 2_147_483_647
STATE = "last long, bytes long, stopped boolean"


def ordered_frames(frames: DataFrame, max_bytes: int = MAX_BYTES, forget: bool = True) -> DataFrame:
    """frames: session, sequence, kind (start, media or stop), n_bytes. One row a frame: status OK, LATE
    (a sequence again or out of order: an error, never reordered), SEQUENCE (beyond the largest), CLOSED (after
    stop) or TOO_LARGE; the sequences missing before it, as a range, and one by one up to LISTED of them; and the time at which its sound begins. A batch's frames are taken by
    sequence; with `forget`, a session without frames for IDLE_S seconds loses its state (such a query runs
    on and on; one that is to end with its input goes without)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, total, stopped = state.get if state.exists else (0, 0, False)
        out = []
        for r in pd.concat(list(batches)).sort_values("sequence", kind="stable").itertuples():
            first, missing, size = None, [], int(r.n_bytes) if r.kind == "media" and pd.notna(r.n_bytes) else 0
            if stopped:
                status = "CLOSED"
            elif r.sequence > MAX_SEQUENCE:
                status = "SEQUENCE"
            elif r.sequence <= last:
                status = "LATE"
            elif total + size > max_bytes:
                status, stopped = "TOO_LARGE", True
            else:
                status, stopped = "OK", r.kind == "stop"
                first = last + 1 if r.sequence > last + 1 else None
                missing = list(range(last + 1, min(int(r.sequence), last + 1 + LISTED)))
                last = int(r.sequence)
            out.append((key[0], int(r.sequence), status, missing, first, None if first is None else int(r.sequence) - 1, total // BYTES_PER_MS))
            total += size if status == "OK" else 0
        state.update((last, total, stopped))
        if forget:
            state.setTimeoutDuration(IDLE_S * 1000)
        rows = pd.DataFrame(out, columns=["session", "sequence", "status", "missing", "first_missing", "last_missing", "at_ms"])
        yield rows.astype({"first_missing": "Int64", "last_missing": "Int64"})

    rows = frames.select("session", "sequence", "kind", "n_bytes").filter("session is not null and sequence is not null")
    return rows.groupBy("session").applyInPandasWithState(step, RESULT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, late: str = "1 minute", gap: str = f"{IDLE_S} seconds") -> DataFrame:
    """events: key, ts. Sessions that a gap ends, with their number of events; later rows than the
    watermark allows are left to Spark."""
    return events.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_finals(parts: DataFrame, late: str = "15 minutes") -> DataFrame:
    """parts: call_id, utterance_id, is_final, ts. Final utterances, each once; partial ones pass by."""
    return parts.filter("is_final").withWatermark("ts", late).dropDuplicatesWithinWatermark(["call_id", "utterance_id"])
