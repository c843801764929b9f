"""Pinned cases for operators, sources and streams."""

import hashlib
import json
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from callgrid.operators import evaluation, intervals, privacy, sentiment, wer
from callgrid.plans import language
from callgrid.plans.catalog import QUERIES
from callgrid.sources import files
from callgrid.sources.derived import view
from callgrid.streaming import frames

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("start,opportunity,holds,at", [(0, 30000, [(10000, 15000)], 35000), (0, 1, [(0, 500000)], 500001), (0, 30000, [], 30000)])
def test_holds_move_the_deadline(spark, start, opportunity, holds, at):
    listed = F.array(*[F.struct(F.lit(a).cast("long").alias("start_ms"), F.lit(b).cast("long").alias("end_ms")) for a, b in holds]).cast("array<struct<start_ms:bigint,end_ms:bigint>>")
    assert one(spark, intervals.paused_deadline(F.lit(start), F.lit(opportunity), intervals.merged_array(listed))) == at


def test_cooldown_counts_from_the_alert_kept_last(spark):
    alerts = F.array(*[F.lit(x).cast("long") for x in (60000, 90000, 120000, 150000, 180000)])
    assert one(spark, sentiment.cooled(alerts)) == [60000, 150000]


@pytest.mark.parametrize("fall,prob,fires", [("0.2", "0.8", True), ("0.2000000000005", "0.8", False), ("0.2", "0.7", True), ("0.2", "0.6999999999999", False)])
def test_drop_edges(spark, fall, prob, fires):
    rows = [("c", w * 30000 + i, s, prob) for w, s in ((0, "0.6"), (1, fall)) for i in range(3)]
    signals = spark.createDataFrame(rows, "call_id string, start_ms long, score string, prob string")
    assert (sentiment.drop_windows(signals).count() == 1) is fires


def test_evaluation_report(spark):
    cases = spark.createDataFrame([(f"case-{i}", i == 4, i == 3) for i in range(5)], "case_id string, excluded boolean, abstained boolean")
    dims = spark.createDataFrame([("case-0", 4.0, 4.0), ("case-1", 3.0, 4.0), ("case-3", 2.0, 1.0)], "case_id string, gold double, predicted double")
    r = evaluation.report(cases, dims).first()
    assert (r["total"], r["eligible"], r["abstained"], r["covered"], r["coverage"], r["mean_absolute_error"]) == (5, 4, 1, 3, 0.75, 0.5)


def test_redaction():
    assert privacy.redacted("write to ann@example.com or +44 20 7946 0958") == "write to [REDACTED] or [REDACTED]"
    assert privacy.redacted(None) is None
    with pytest.raises(ValueError):
        privacy.redacted("x" * 11, limit=10)


def test_evaluation_source(spark, tmp_path):
    good = {"case_id": "case-1", "excluded": False, "abstained": False, "gold_findings": [], "predicted_findings": [], "gold_dimensions": {"a": 3}, "predicted_dimensions": {"a": 5}}
    rows = [good, good | {"case_id": "case-2", "excluded": True, "abstained": True}, good | {"case_id": "case-3", "gold_dimensions": {"a": 9}}, good | {"case_id": "x"}, good]
    path = tmp_path / "cases.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    got = {tuple(r) for r in files.case_faults(files.evaluation_cases(spark, str(path))).collect()}
    assert got == {("case-1", "repeated"), ("case-2", "flags"), ("case-3", "scores"), ("x", "identifier")}


def test_pinned_json(tmp_path):
    path = tmp_path / "a.json"
    path.write_text('{"a": 1}')
    assert files.pinned_json(str(path), hashlib.sha256(path.read_bytes()).hexdigest()) == {"a": 1}
    with pytest.raises(files.SourceError):
        files.pinned_json(str(path), "0" * 64)


def test_frame_stream_reports_gaps(spark, tmp_path):
    schema = "session string, sequence long, kind string, n_bytes int"
    src = tmp_path / "in"
    rows = [[("s", 1, "start", None), ("s", 3, "media", 320), ("t", 1, "media", 160)], [("s", 5, "media", 320), ("s", 3, "media", 320), ("s", 6, "stop", None), ("s", 7, "media", 1)]]
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    query = frames.ordered_frames(stream, forget=False).writeStream.format("memory").queryName("frames_out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["session"], r["sequence"], r["status"], tuple(r["missing"])) for r in spark.table("frames_out").collect()}
    assert got == {("s", 1, "OK", ()), ("s", 3, "OK", (2,)), ("t", 1, "OK", ()), ("s", 5, "OK", (4,)), ("s", 3, "LATE", ()), ("s", 6, "OK", ()), ("s", 7, "CLOSED", ())}


def full_table_align(ref, hyp):
    """Ops over the whole table of edit distances, with the operator's order on equal cost."""
    d = [[i + j if not i or not j else 0 for j in range(len(hyp) + 1)] for i in range(len(ref) + 1)]
    for i in range(1, len(ref) + 1):
        for j in range(1, len(hyp) + 1):
            d[i][j] = min(d[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    ops, i, j = [], len(ref), len(hyp)
    while i or j:
        if i and j and ref[i - 1] == hyp[j - 1] and d[i - 1][j - 1] == d[i][j]:
            op, i, j = ("match", ref[i - 1], hyp[j - 1]), i - 1, j - 1
        elif j and d[i][j - 1] + 1 == d[i][j]:
            op, j = ("insert", None, hyp[j - 1]), j - 1
        elif i and d[i - 1][j] + 1 == d[i][j]:
            op, i = ("delete", ref[i - 1], None), i - 1
        else:
            op, i, j = ("substitute", ref[i - 1], hyp[j - 1]), i - 1, j - 1
        ops.append(op)
    return ops[::-1]


@pytest.mark.parametrize("block", [0, 40, 1 << 20])
def test_alignment_by_blocks_is_that_of_the_whole_table(monkeypatch, block):
    monkeypatch.setattr(wer, "BLOCK", block)
    rng = random.Random(3)
    for n, m in [(0, 0), (0, 5), (5, 0), (1, 1), (9, 30), (30, 9), (64, 60), (100, 101)]:
        ref, hyp = ([rng.choice("abcd") for _ in range(k)] for k in (n, m))
        assert wer.align(ref, hyp) == full_table_align(ref, hyp)


def test_alignment_of_long_texts_is_bounded():
    ref = [f"w{i}" for i in range(8000)]
    hyp = [w for i, w in enumerate(ref) if i % 10]
    tracemalloc.start()
    kinds = [o[0] for o in wer.align(ref, hyp)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (kinds.count("match"), kinds.count("delete"), len(kinds)) == (7200, 800, 8000) and peak < 64 << 20


def test_word_errors_takes_whole_turns(spark, monkeypatch):
    text = " ".join(f"word{i}" for i in range(600))
    turns = spark.createDataFrame([(1, 0, "CUSTOMER", text + " tail"), (1, 1, "AGENT", text + " other more")], "call_id long, turn long, role string, text string")
    monkeypatch.setattr(language, "view", lambda spark, sf_dir, name: turns)
    r = language.word_errors(spark, "").first()
    assert (r["n_reference"], r["matches"], r["substitutions"], r["deletions"], r["insertions"]) == (601, 600, 1, 0, 1)


def test_every_call_gets_its_hold_deadline(spark):
    holds = {}
    for r in view(spark, SF, "v_intervals").select("call_id", "start_ms", "end_ms").collect():
        holds.setdefault(r["call_id"], []).append((r["start_ms"], r["end_ms"]))
    want = {}
    for c, spans in holds.items():
        held = sorted(spans)
        at, clock = c * 100 + 30000, c * 100
        for a, b in held:  # holds may overlap: what lies before the clock has been counted
            if a >= at:
                break
            at, clock = at + max(0, b - max(a, clock)), max(clock, b)
        want[c] = at
    assert {c % 3 for c in want} == {0, 1, 2}
    assert {r["call_id"]: r["deadline_ms"] for r in QUERIES["hold_deadline"](spark, SF).collect()} == want
