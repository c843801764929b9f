"""Cases that once ended a query, lost rows or kept state."""

import json

import pytest
from pyspark.sql import functions as F

from callgrid.functions.text import casefolded, normalised_phrase, normalised_words
from callgrid.operators import disposition, reports, responses, retention, wer
from callgrid.operators.audit import WEIGHTS
from callgrid.plans.calls import CLASSES
from callgrid.streaming import frames, windows
from callgrid.streaming.run import drained, streamed
from tests_source import source


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Streams over a handful of rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_case_folding_is_full(spark):
    texts = ["STRASSE", "straße", "STRAẞE", "ﬀ ﬁ ﬃ", "ΣΊΣΥΦΟΣ σίσυφος", "ǰ ŉ ΐ", "Ꭰ ꭰ", "plain ASCII", "", "ſ K Å", "İstanbul", "և ﬓ", "ᾳ ᾲ ᾷ"]
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", casefolded(F.col("t")), normalised_phrase(F.col("t"))).collect()]
    assert [f for _, f, _ in got] == [t.casefold() for t in texts]
    assert {p for t, _, p in got if t.lower().startswith("stra")} == {"strasse"} and wer.words("Die STRASSE.") == wer.words("die straße")
    assert spark.createDataFrame([("Die STRAẞE, ja!",)], "t string").select(normalised_words(F.col("t"))).collect()[0][0] == ["die", "strasse", "ja"]
    assert spark.createDataFrame([(None,)], "t string").select(casefolded(F.col("t"))).collect()[0][0] is None


def test_a_repeated_utterance_is_one_calls_fault(spark):
    quote = [{"utterance_id": "1", "quote": "hello"}]
    dims = [{"id": i, "status": "SCORED", "score": 4, "reason": "fine", "evidence": quote} for i in WEIGHTS]
    good = json.dumps({"dimensions": dims, "coaching_narrative": {"text": "well", "evidence": quote}, "highlights": [], "improvement_areas": []})
    said = [(1, "1", "AGENT", "hello there", True), (2, "1", "AGENT", "hello there", True), (2, "1", "AGENT", "hello again", True), (3, "1", "CUSTOMER", "hello", True)]
    spoken = spark.createDataFrame(said, "call_id long, id string, role string, text string, is_final boolean")
    asked = spark.createDataFrame([(c, good, False) for c in (1, 2, 3)], "call_id long, response string, objection_absent boolean")
    got = {r["call_id"]: r["fault"] for r in responses.checked_responses(asked, spoken).collect()}
    assert got[1] is None and got[2] == "REPEATED_UTTERANCE" and got[3] is not None
    count = spark.sparkContext.accumulator(0)

    def evaluate(payload, fault):
        count.add(1)
        return good

    payloads = spark.createDataFrame([(1, "{}", False), (2, "{}", False)], "call_id long, payload string, objection_absent boolean")
    out = responses.audited(payloads, spoken, evaluate)
    assert {r["call_id"]: r["fault"] for r in out.collect()} == {1: None, 2: "INVALID_MODEL_OUTPUT"}
    asked_ = count.value
    out.collect()
    assert count.value == asked_  # the answers are read again, not asked for again


def test_window_state_ends_with_its_session(spark, tmp_path):
    schema = "session string, window_ms long, segments array<struct<start_ms:long,end_ms:long,text:string>>"
    seg = lambda s, e, t: {"start_ms": s, "end_ms": e, "text": t}
    rows = [[{"session": "a", "window_ms": 0, "segments": [seg(0, 3500, "x")]}, {"session": "b", "window_ms": 0, "segments": [seg(0, 3500, "y")]}], [{"session": "a", "window_ms": None, "segments": []}]]
    checkpoint = str(tmp_path / "cp")
    drained(windows.utterances(source(spark, tmp_path / "in", schema, rows)), checkpoint)
    held = spark.read.format("statestore").load(checkpoint).collect()
    assert [r["key"]["session"] for r in held] == ["b"]
    signals = [[{"call_id": 1, "start_ms": 0, "score": "0.5", "prob": "0.9", "ended": False}, {"call_id": 2, "start_ms": 0, "score": "0.5", "prob": "0.9", "ended": False}], [{"call_id": 1, "ended": True}]]
    checkpoint = str(tmp_path / "cp2")
    drained(windows.alerts(source(spark, tmp_path / "in2", "call_id long, start_ms long, score string, prob string, ended boolean", signals)), checkpoint)
    assert [r["key"]["call_id"] for r in spark.read.format("statestore").load(checkpoint).collect()] == [2]


def test_a_jump_of_frames_costs_nothing(spark):
    rows = spark.createDataFrame([("s", 1, "start", 0), ("s", 2_147_483_647, "media", 4), ("s", 2_147_483_648, "media", 4), ("t", 3, "start", 0)], "session string, sequence long, kind string, n_bytes long")
    got = {(r["session"], r["sequence"]): (r["status"], len(r["missing"]), r["first_missing"], r["last_missing"]) for r in drained(frames.ordered_frames(streamed(rows), forget=False)).collect()}
    assert got == {("s", 1): ("OK", 0, None, None), ("s", 2_147_483_647): ("OK", 1000, 2, 2_147_483_646), ("s", 2_147_483_648): ("SEQUENCE", 0, None, None), ("t", 3): ("OK", 2, 1, 2)}


def test_long_calls_say_so(spark):
    table = spark.createDataFrame([(1, "a b c", [("u", "a b c")]), (2, "a b", [("u", "a")])], "call_id long, reference string, utterances array<struct<id:string,text:string>>")
    got = sorted((r["call_id"], r["op"]) for r in wer.attributions(table, max_words=2).collect())
    assert got == [(1, "TOO_LONG"), (2, "delete"), (2, "match")]
    pairs = spark.createDataFrame([(1, "a " * 30_000, "a " * 300)], "call_id long, reference string, hypothesis string")
    assert [tuple(r) for r in wer.error_counts(pairs).collect()] == [(1, 30_000, 300, 0, 29_700, 0, 0.99)]


def test_export_stops_at_its_limit(spark, tmp_path):
    with pytest.raises(ValueError, match="more rows"):
        reports.exported(spark.range(10_000_000).selectExpr("cast(id as string) id"), str(tmp_path / "e.csv"), limit=3)


def turn(call, i, text="word", role="AGENT", final=True):
    return (call, str(i), role, f"{role}-1", i * 10, i * 10 + 9, text, final)


def test_classification_of_odd_answers(spark):
    good = {"commitment": {"p_yes": 0.9, "confidence": 0.8}, "mood": {"value": 0.5, "confidence": 0.9}, "topic": {"value": "long", "probabilities": {"long": 0.9, "short": 0.1}, "confidence": 0.9}}
    topic = lambda **how: good | {"topic": good["topic"] | how}
    answers = {
        "fine": good, "evidence": good | {"mood": good["mood"] | {"evidence_ids": ["0"]}}, "missing": {k: v for k, v in good.items() if k != "mood"}, "extra": good | {"more": {}}, "foreign": good | {"mood": good["mood"] | {"evidence_ids": ["77"]}},
        "sum": topic(probabilities={"long": 0.9, "short": 0.3}), "option": topic(value="other"), "unsure": topic(confidence=0.5), "range": good | {"commitment": {"p_yes": 1.5, "confidence": 0.8}}, "none": None, "raises": 1,
    }

    def adapter(questions, texts):
        if texts[0] == "gated":
            raise RuntimeError("a gated call is not shown to the model")
        name = texts[-1].split()[0]
        if name in answers:
            return answers[name]
        return good | {"commitment": {"p_yes": 0.1 if name == "no" else 0.9, "confidence": 0.8}}

    names = list(answers)
    rows = [turn(i, 0, n) for i, n in enumerate(names)] + [turn(50, 0, "gated"), turn(51, 0, "x", "IVR"), turn(52, 0, " "), turn(53, 0, "x", final=False), turn(54, 0, "x" * 20_001)]
    rows += [turn(60, 0, "long" + "x" * 3_000), turn(60, 1, "yes " + "x" * 3_000, "CUSTOMER"), turn(60, 2, "no " + "x" * 3_000)]
    table = spark.createDataFrame(rows, "call_id long, id string, role string, speaker string, start_ms long, end_ms long, text string, is_final boolean")
    facts = spark.createDataFrame([(50, "FAILED"), (51, "OK"), (70, "NO_ANSWER"), (71, "OK"), (72, None)], "call_id long, line string")
    config = disposition.compile_config(CLASSES)
    got = {r["call_id"]: (r["status"], r["code"], r["review_reason"], r["matched_rule"]) for r in disposition.classify(table, config, adapter, facts).collect()}
    kept, gated, review = ("RESOLVED", "COMMITTED", None, "KEEN"), ("RESOLVED", "NO_CONTACT", None, "NO_CONNECTION"), lambda why: ("NEEDS_REVIEW", None, why, None)
    want = {i: kept if n in ("fine", "evidence") else review("INVALID_MODEL_OUTPUT") for i, n in enumerate(names)}
    want |= {50: gated, 51: review("UNCERTAIN_SPEAKER_ROLE"), 52: review("EMPTY_TRANSCRIPT_TURN"), 53: review("INCOMPLETE_TRANSCRIPT"), 54: review("CONTEXT_LIMIT"), 60: review("CONFLICTING_CHUNK_SIGNALS")}
    want |= {70: gated, 71: review("INCOMPLETE_TRANSCRIPT"), 72: review("INCOMPLETE_TRANSCRIPT")}
    assert got == want


def test_purge_states_and_snapshots(spark, tmp_path):
    from datetime import datetime

    day = lambda d: datetime(2024, 1, d)
    calls = [(1, day(1), True, None, day(2), None), (2, day(1), False, day(5), day(2), None), (3, None, False, None, day(2), None), (4, day(1), False, None, day(20), None), (5, day(1), False, None, day(2), None), (6, day(1), None, None, None, day(3)), (7, day(1), False, None, None, None)]
    table = spark.createDataFrame([(*c, "agent") for c in calls], "call_id long, tombstoned_at timestamp, legal_hold boolean, content_purged_at timestamp, retention_expires_at timestamp, deletion_requested_at timestamp, agent_id string")
    now = F.lit(day(10))
    states = {r["call_id"]: r["s"] for r in table.select("call_id", retention.purge_state(now).alias("s")).collect()}
    assert states == {1: "HELD", 2: "ALREADY_PURGED", 3: "NOT_TOMBSTONED", 4: "NOT_DUE", 5: "PURGED", 6: "PURGED", 7: "NOT_DUE"}
    jobs = spark.createDataFrame([(1,), (5,), (5,), (None,), (9,)], "call_id long")
    marked = spark.createDataFrame([(5, None), (6, day(1)), (1, None)], "call_id long, content_purged_at timestamp")
    purge = retention.Purge(table, now, {"jobs": jobs}, {"sessions": marked}, {"audits": jobs})
    assert purge.write(str(tmp_path)) == {"calls": (7, 2), "jobs": (5, 2), "sessions": (3, 2), "audits": (5, 2)}
    read = lambda n: spark.read.parquet(str(tmp_path / n))
    assert {r["call_id"] for r in read("jobs").collect()} == {1, None, 9} and read("audits").count() == 5
    assert {r["call_id"]: r["content_purged_at"] for r in read("sessions").collect()} == {5: day(10), 6: day(1), 1: None}
    assert {r["call_id"] for r in read("calls").filter("agent_id = '[deleted]'").collect()} == {5, 6} and read("calls").filter("content_purged_at is not null").count() == 3


def test_segments_with_faults(spark):
    from callgrid.operators.operations import prepared_segments, segment_faults

    nan, inf = float("nan"), float("inf")
    rows = [(1, 0.0, 1.0, "a"), (2, nan, 1.0, "a"), (3, 0.0, nan, "a"), (4, 0.0, inf, "a"), (5, -1.0, 1.0, "a"), (6, 2.0, 1.0, "a"), (7, 0.0, 7200.001, "a"), (8, None, 1.0, "a"), (9, nan, 1.0, "  "), (10, 0.0, 7200.0, "a"), (11, 1.0, 2.0, "a"), (11, 3.0, 4.0, "b"), (12, 1.0, 2.0, "a"), (12, 1.0, 2.0, "")]
    table = spark.createDataFrame([(*r, 0, True, 0.5) for r in rows], "id long, start_s double, end_s double, text string, channel int, trusted boolean, confidence double")
    got = sorted(tuple(r) for r in segment_faults(table).collect())
    assert got == [(2, "TIMING"), (3, "TIMING"), (4, "TIMING"), (5, "TIMING"), (6, "TIMING"), (7, "TIMING"), (8, "TIMING"), (11, "REPEATED")]
    assert sorted(r["id"] for r in prepared_segments(table.filter("id in (1, 10, 12)"), strict=True).collect()) == [1, 10, 12]
    for bad in (2, 11):
        with pytest.raises(Exception, match=f"segment {bad}"):
            prepared_segments(table.filter(f"id in (1, {bad})"), strict=True).collect()


def test_recognisers_take_batches(spark):
    from callgrid.operators.privacy import batch_redactor

    calls = spark.sparkContext.accumulator(0)

    def names(texts):
        calls.add(1)
        return [[(t.index("Ann"), t.index("Ann") + 3), (0, 2), (90, 99)] if "Ann" in t else [] for t in texts]

    rows = [(i, t) for i, t in enumerate(["so Ann said", None, "", "call 0151 2345 6789 now", "Ann"] * 40)]
    table = spark.createDataFrame(rows, "i long, t string").coalesce(1)
    got = {r["i"] % 5: r["s"] for r in table.select("i", batch_redactor(names)(F.col("t")).alias("s")).collect()}
    assert got == {0: "[REDACTED] [REDACTED] said", 1: None, 2: "", 3: "call [REDACTED] now", 4: "[REDACTED]"} and calls.value == 1
    for bad in (batch_redactor(lambda texts: []), batch_redactor(names, limit=5)):
        with pytest.raises(Exception, match="recogniser|too long"):
            table.select(bad(F.col("t"))).collect()
