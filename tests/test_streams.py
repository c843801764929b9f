"""Live sessions, live rows, media sessions and the feed as streams."""

import base64
import json
import os
import pathlib
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from callgrid.operators import intake, operations
from callgrid.operators.scope import Scope
from callgrid.plans.catalog import QUERIES
from callgrid.sources.derived import view
from callgrid.streaming import feed, media, sessions
from callgrid.streaming.run import drained, keyed_state
from tests_source import source

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Streams over a handful of rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


EVENT = "session_id string, ts timestamp, event_id long, move string, generation long"


def event(i, session, second, move, generation=None):
    return {"session_id": session, "ts": f"2024-01-01 00:{second // 60:02}:{second % 60:02}", "event_id": i, "move": move, "generation": generation}


def test_lifecycle_rejects_late_moves_and_ends_idle_sessions(spark, tmp_path):
    batches = [
        [event(1, "a", 0, "START"), event(2, "b", 0, "START"), event(3, "x", 1, "DRAINING"), event(4, "d", 0, "START")],
        [event(5, "a", 60, "ACTIVITY", 1), event(6, "b", 61, "DRAINING", 1), event(7, "b", 62, "ENDED", 1), event(8, "b", 63, "INCOMPLETE", 1), event(9, "d", 80, "DRAINING")],
        [event(10, "b", 100, "START"), event(11, "b", 101, "ENDED", 1), event(12, "b", 102, "ACTIVITY", 2), event(13, "a", 155, "ACTIVITY", 1)],
        [event(14, "z", 3000, "START"), event(15, None, 3000, "START")],
        [event(16, "z", 3599, "ACTIVITY")],
    ]
    stream = source(spark, tmp_path / "in", EVENT, batches)
    checkpoint = str(tmp_path / "cp")
    out = drained(sessions.lifecycle(stream, sessions.Limits(keep_s=600, drain_s=300)), checkpoint, str(tmp_path / "out"))
    got = {(r["event_id"], r["session_id"]): (r["outcome"], r["state"], r["generation"]) for r in out.filter("event_id is not null").collect()}
    assert got == {
        (1, "a"): ("APPLIED", "LIVE", 1), (2, "b"): ("APPLIED", "LIVE", 1), (3, "x"): ("NO_SESSION", None, None), (4, "d"): ("APPLIED", "LIVE", 1),
        (5, "a"): ("APPLIED", "LIVE", 1), (6, "b"): ("APPLIED", "DRAINING", 1), (7, "b"): ("APPLIED", "ENDED", 1), (8, "b"): ("NOT_ALLOWED", "ENDED", 1), (9, "d"): ("APPLIED", "DRAINING", 1),
        (10, "b"): ("APPLIED", "LIVE", 2), (11, "b"): ("STALE_GENERATION", "LIVE", 2), (12, "b"): ("APPLIED", "LIVE", 2), (13, "a"): ("NOT_ALLOWED", "INCOMPLETE", 1),
        (14, "z"): ("APPLIED", "LIVE", 1), (16, "z"): ("NOT_ALLOWED", "INCOMPLETE", 1),
    }
    second = lambda s: 1_704_067_200_000_000 + s * 1_000_000
    timed = {(r["session_id"], r["us"], r["generation"]) for r in out.filter("outcome = 'TIMED_OUT'").collect()}
    assert timed == {("a", second(150), 1), ("b", second(192), 2), ("d", second(380), 1), ("z", second(3090), 1)}
    # all but the last session are past their time, and nothing of them is kept
    with keyed_state(spark):
        held = [r["key"]["session_id"] for r in spark.read.format("statestore").option("stateVarName", "session").load(checkpoint).collect()]
    assert held == ["z"]


def test_lifecycle_equals_the_batch_forms(spark, tmp_path):
    """Moves by the batch fold; time-outs by the batch sweep."""
    moves = {"click": "DRAINING", "signup": "ENDED", "error": "INCOMPLETE"}
    rows = view(spark, SF, "v_event_ms").orderBy("us", "event_id").collect()
    batches, started = [[], [], []], set()
    for i, r in enumerate(rows):
        part, ts = batches[i * 3 // len(rows)], f"{r['us'] // 1_000_000}"
        stamp = time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(int(ts))) + f".{r['us'] % 1_000_000:06}"
        if r["user_id"] not in started:
            started.add(r["user_id"])
            part.append({"session_id": str(r["user_id"]), "ts": stamp, "event_id": -1, "move": "START"})
        if r["event_type"] in moves:
            part.append({"session_id": str(r["user_id"]), "ts": stamp, "event_id": r["event_id"], "move": moves[r["event_type"]]})
    stream = source(spark, tmp_path / "in", EVENT, batches)
    out = drained(sessions.lifecycle(stream, sessions.Limits(None, None, None)))
    got = {(r["session_id"], r["state"]) for r in out.groupBy("session_id").agg(F.max_by("state", F.struct("us", "event_id")).alias("state")).collect()}
    assert got == {(str(r["session_id"]), r["state"]) for r in QUERIES["session_states"](spark, SF).collect()}
    now = 1_706_572_800_000_000
    states, batch = view(spark, SF, "v_sessions").filter(f"state in ('LIVE', 'DRAINING') and updated_us <= {now}").collect(), []
    at = lambda us: time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(us // 1_000_000)) + f".{us % 1_000_000:06}"
    for r in states:
        batch.append({"session_id": str(r["session_id"]), "ts": at(r["updated_us"]), "event_id": 1, "move": "START"})
        if r["state"] == "DRAINING":
            batch.append({"session_id": str(r["session_id"]), "ts": at(r["updated_us"]), "event_id": 2, "move": "DRAINING"})
    stream = source(spark, tmp_path / "late", EVENT, [batch, [{"session_id": "clock", "ts": at(now), "event_id": 3, "move": "START"}]])
    out = drained(sessions.lifecycle(stream, sessions.Limits(keep_s=None), "0 seconds"))
    want = {str(r["session_id"]) for r in operations.timed_out(view(spark, SF, "v_sessions"), now).collect()}
    assert {r["session_id"] for r in out.filter("outcome = 'TIMED_OUT'").collect()} == want and want


UTTERANCE = "session_id string, utterance_id string, event_id long, start_ms long, text string"


def test_live_rows_in_the_state(spark, tmp_path):
    """What is held after each batch equals the batch form; expired entries go by the clock, without input."""
    row = lambda i, s, u, start, text: dict(session_id=s, utterance_id=u, event_id=i, start_ms=start, text=text)
    batches = [
        [row(1, "s", "u1", 0, "one"), row(2, "s", "u2", 10, "two"), row(3, "s", "u1", 5, "one!"), row(4, "t", "v", 0, "x"), row(5, None, "v", 0, "x")],
        [row(6, "s", "u3", 20, "three"), row(7, "s", "u4", 30, "four"), row(8, "s", "u2", 11, "two!")],
    ]
    # the batch form holds the newest text of each utterance
    kept, held_by_batch = spark.createDataFrame([], "session_id string, utterance_id string, text string, expires_us long"), []
    for i, rows in enumerate(batches):
        newest = {(r["session_id"], r["utterance_id"]): r["text"] for r in sorted(rows, key=lambda r: r["event_id"]) if r["session_id"]}
        kept = intake.buffered(kept, spark.createDataFrame([(*k, t) for k, t in newest.items()], "session_id string, utterance_id string, text string"), i)
        held_by_batch.append({(r["session_id"], r["utterance_id"], r["text"]) for r in kept.filter("session_id = 's'").collect()})
    assert held_by_batch[1] == {("s", "u1", "one!"), ("s", "u2", "two!"), ("s", "u3", "three"), ("s", "u4", "four")}
    folder, checkpoint = tmp_path / "in", str(tmp_path / "cp")
    source(spark, folder, UTTERANCE, batches[:1])
    stream = spark.readStream.schema(UTTERANCE).option("maxFilesPerTrigger", 1).json(str(folder))
    with keyed_state(spark):
        query = sessions.live_rows(stream, 20, most=3).writeStream.format("memory").queryName("live_rows_out").option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime="1 second").start()

        def held():
            try:
                state = spark.read.format("statestore").option("stateVarName", "rows").load(checkpoint).collect()
            except Exception:  # noqa: BLE001  no batch is there yet
                return None
            return {(r["key"]["session_id"], r["user_map_key"]["utterance_id"], r["user_map_value"]["value"]["text"]) for r in state}

        def until(want):
            end = time.time() + 90
            while (now := held()) is None or {x for x in now if x[0] == "s" or not want} != want and time.time() < end:
                time.sleep(0.5)
            assert time.time() < end

        try:
            until(held_by_batch[0])
            source(spark, folder, UTTERANCE, batches)
            until({x for x in held_by_batch[1] if x[1] != "u1"})  # the three latest
            assert [r["utterance_id"] for r in spark.table("live_rows_out").filter("change = 'TRUNCATED'").collect()] == ["u1"]
            until(set())
        finally:
            query.stop()


LINE = "account_id string, call_id string, generation long, ts timestamp, arrival long, value string"


def test_media_sessions_from_raw_lines(spark, tmp_path):
    text = lambda event, n=None, **more: json.dumps({"event": event, **({} if n is None else {"sequence_number": n}), **more})
    form = {"encoding": "raw", "sample_rate": 8000, "channels": 1, "bit_rate": 16}
    begin = lambda n=1, **more: text("start", n, stream_sid="s", start={"stream_sid": "s", "call_sid": "c", "account_sid": "a", "media_format": form, **more})
    sound = lambda n, chunk=1, stamp="0", payload=b"\x01\x00", sid="s": text("media", n, stream_sid=sid, media={"chunk": chunk, "timestamp": stamp, "payload": base64.b64encode(payload).decode()})
    end = lambda n, call="c": text("stop", n, stream_sid="s", stop={"call_sid": call, "account_sid": "a"})
    calls = {
        "whole": [(text("connected"), "OK"), (begin("4", media_format={"encoding": "base64", "sample_rate": "8000", "bit_rate": "128kbps"}), "OK"), (sound("6", 1, "12"), "OK"), (sound(7, 4, "12"), "OK"), (end("9"), "OK"), (sound(10, 9), "CLOSED")],
        "order": [(begin(), "NOT_CONNECTED"), (text("connected"), "OK"), (text("connected"), "CONNECTED"), (sound(1), "NOT_STARTED"), (begin(account_sid="other"), "IDENTITY"), (begin(injected="x"), "FIELDS"), (begin(custom_parameters=dict.fromkeys("abcd", "x")), "FIELDS"), (begin(custom_parameters={"a": 1}), "FIELDS"), (begin(**{"from": 7}), "FIELDS"), (begin(media_format=form | {"encoding": "wav"}), "FORMAT"), (begin(media_format=form | {"rate": 1}), "FORMAT"), (begin(custom_parameters={"a": "b"}, to="x"), "OK"), (begin(2), "START")]
        + [(sound(2), "OK"), (sound(2, 2), "LATE"), (sound(1, 2), "LATE"), (sound(3, 2, "1", sid="other"), "STREAM"), (sound(3, 1), "CHUNK"), (sound(3, "2"), "CHUNK"), (sound(3, 2, "-1"), "TIMESTAMP"), (sound(3, 2, "NaN"), "TIMESTAMP"), (sound(3, 2, payload=b"\0"), "PAYLOAD"), (sound(3, 2, payload=b"x" * 100_002), "PAYLOAD"), (sound(3, 2, "7200000", b"\0" * 32), "DURATION"), (sound("9999999999", 2), "SEQUENCE"), (text("dance", 3, stream_sid="s"), "KIND"), ("{", "NOT_JSON"), ("", "NOT_JSON"), (end(3, "other"), "IDENTITY"), (sound(2_147_483_647, 2_147_483_647, 5), "OK")],
    }
    rows, want = [], {}
    for name, lines in calls.items():
        for i, (value, status) in enumerate(lines):
            rows.append({"account_id": "a", "call_id": "c", "generation": 1, "ts": "2024-01-01 00:00:00", "arrival": i, "value": value} | ({"generation": 2} if name == "order" else {}))
            want[name, i] = status
    first, second = rows[: len(calls["whole"])], rows[len(calls["whole"]) :]
    for i, r in enumerate(second):
        r["arrival"] = i + 100
    stale = [first[2] | {"arrival": 300}]
    last = {"account_id": "a", "call_id": "other", "generation": 1, "ts": "2024-01-01 01:00:00", "arrival": 1, "value": text("connected")}
    stream = source(spark, tmp_path / "in", LINE, [first, second[:8], second[8:] + stale, [last], [last | {"arrival": 2, "ts": "2024-01-01 01:00:01"}]])
    checkpoint = str(tmp_path / "cp")
    out = drained(media.media_sessions(stream), checkpoint, str(tmp_path / "out"))
    got = {r["arrival"]: r for r in out.filter("arrival is not null and call_id = 'c'").collect()}
    assert [got[i]["status"] for i in range(len(first))] == [s for _, s in calls["whole"]]
    assert [got[100 + i]["status"] for i in range(len(second))] == [s for _, s in calls["order"]]
    assert got[300]["status"] == "STALE_GENERATION"
    ranges = lambda r: tuple(r[c] for c in ("first_missing", "last_missing", "first_missing_chunk", "last_missing_chunk"))
    assert [ranges(got[i]) for i in range(1, 5)] == [(1, 3, None, None), (5, 5, None, None), (None, None, 2, 3), (8, 8, None, None)]
    assert ranges(got[100 + len(second) - 1]) == (3, 2_147_483_646, 2, 2_147_483_646)
    assert [(r["call_id"], r["status"]) for r in out.filter("arrival is null").collect()] == [("c", "ABANDONED")]
    with keyed_state(spark):
        assert [r["key"]["call_id"] for r in spark.read.format("statestore").option("stateVarName", "session").load(checkpoint).collect()] == ["other"]


FEED = "us long, call_id long, agent_id string, team_id string, event_type string"


def test_feed_sink_repeats_batches_and_purges(spark, tmp_path):
    row = lambda us, org, call, kind="call.updated": {"organisation_id": org, "us": us, "call_id": call, "agent_id": "x", "team_id": "t", "event_type": kind}
    batches = [[row(3, "o", 1), row(1, "o", 2), row(2, "p", 3), row(9, None, 3)], [row(4, "o", 1), row(5, "o", 3)], [row(7, "o", 4), row(6, "p", 5), row(8, "q", 6)]]
    stream = source(spark, tmp_path / "in", "organisation_id string, " + FEED, batches)
    f = feed.fed(stream, feed.Feed(spark, str(tmp_path / "feed"), FEED, history=4), "us", "call_id")
    numbers = lambda: sorted((r["organisation_id"], r["sequence"], r["us"]) for r in f.events().collect())
    want = [("o", 2, 3), ("o", 3, 4), ("o", 4, 5), ("o", 5, 7), ("p", 1, 2), ("p", 2, 6), ("q", 1, 8)]
    assert numbers() == want
    again = spark.createDataFrame([(r["organisation_id"], r["us"], r["call_id"], r["agent_id"], r["team_id"], r["event_type"]) for r in batches[2]], "organisation_id string, " + FEED)
    f.writer("us", "call_id")(again, 2)  # a batch repeated after a failure
    assert numbers() == want
    f._drop("counters/batch=2")  # one that failed between its two writes
    f.writer("us", "call_id")(again, 2)
    assert numbers() == want and sorted((r["organisation_id"], r["last"]) for r in f.counters().collect()) == [("o", 5), ("p", 2), ("q", 1)]
    f.writer("us", "call_id")(again.limit(0), 3)
    assert numbers() == want
    who = Scope("o", "qa", "QA_ANALYST")
    assert [r["sequence"] for r in f.read(who, 1, 2).collect()] == [2, 3]
    with pytest.raises(ValueError, match="ahead"):
        f.read(who, 6)
    gone = spark.createDataFrame([("o", 1), ("r", 9)], "organisation_id string, call_id long")
    f.purge(gone)
    assert numbers() == [w for w in want if w[:2] > ("o", 3)]
    stored = spark.read.parquet(str(tmp_path / "feed" / "events"))
    assert stored.filter("organisation_id = 'o' and sequence <= 3").count() == 0  # gone from the files too
    reset = f.read(who, 2).collect()
    assert [(r["sequence"], r["event_type"], r["call_id"]) for r in reset] == [(5, "reset_required", None)]
    assert [r["sequence"] for r in f.read(who, 3).collect()] == [4, 5] and f.read(Scope("none", "qa", "QA_ANALYST"), 0).count() == 0
    shown = feed.frames(f.read(who, 4), F.struct("call_id")).collect() + feed.frames(f.read(who, 0), F.struct("call_id")).collect()
    assert [r["frame"] for r in shown] == ['id: 5\nevent: call.updated\ndata: {"call_id":4}\n\n', 'id: 5\nevent: reset_required\ndata: {"reason":"cursor_expired"}\n\n']
    f.writer("us", "call_id")(again, 4)
    assert [w for w in numbers() if w[0] == "o"] == [("o", 4, 5), ("o", 5, 7), ("o", 6, 7)]


ELSEWHERE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config(map={"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "1"}).getOrCreate()
from callgrid.session import ship
from callgrid.streaming import run, sessions
ship(spark)
rows = spark.sql("select 'a' session_id, timestamp'2024-01-01' ts, 1L event_id, 'START' move, cast(null as long) generation")
print([r["outcome"] for r in run.drained(sessions.lifecycle(run.streamed(rows))).collect()])
"""


def test_streams_run_from_any_folder(tmp_path):
    """Spark looks at a stateful processor in a process that knows no files sent to executors."""
    top = str(pathlib.Path(sessions.__file__).parents[2])
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_CONF_DIR")}
    out = subprocess.run([sys.executable, "-c", ELSEWHERE, top], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "['APPLIED']" in out.stdout, out.stderr[-2000:]
