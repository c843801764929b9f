"""Live windows, alerts on a stream, evaluation files, media files and redaction on pinned cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from callgrid.operators import audit, disposition, media, privacy, reports, sentiment, wer
from callgrid.operators.scope import Scope
from callgrid.plans.calls import CONFIG
from callgrid.plans.catalog import QUERIES
from callgrid.sources import files
from callgrid.sources.derived import view
from callgrid.streaming import frames, windows

SF = "/root/testdata/sf0.001"


def streamed(spark, tmp_path, schema, batches, query):
    """The rows of a query over batches that arrive one after another."""
    src = tmp_path / "in"
    for i, batch in enumerate(batches):
        path = tmp_path / f"b{i}"
        spark.createDataFrame(batch, schema).coalesce(1).write.json(str(path))
        src.mkdir(exist_ok=True)
        part = next(path.glob("part-*.json"))
        part.rename(src / f"{i:03}.json")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    name = f"t{random.randrange(10**9)}"
    q = query(rows).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in spark.table(name).collect()]


def test_utterances_become_final_once(spark, tmp_path):
    schema = "session string, window_ms long, segments array<struct<start_ms:long,end_ms:long,text:string>>"
    batches = [[("s", 0, [(0, 1000, "hello"), (2500, 3900, "how are")])], [("s", 3000, [(2600, 5200, "how are you")])], [("s", 0, [(0, 500, "late")]), ("s", 6000, [(6500, 9500, "bye")])], [("s", None, [])]]
    got = streamed(spark, tmp_path, schema, batches, windows.utterances)
    assert got == [("s", 2, 2500, 3900, "how are", False), ("s", 1, 0, 1000, "hello", True), ("s", 2, 2600, 5200, "how are you", True), ("s", 3, 6500, 9500, "bye", False), ("s", 3, 6500, 9500, "bye", True)]


def test_settle_takes_each_pending_segment_once():
    pending, n, out = windows.settle([], 0, 0, [(0, 3500, "a"), (100, 3600, "b")])
    assert [x[:1] + x[3:] for x in out] == [(1, "a", False), (2, "b", False)]
    pending, n, out = windows.settle(pending, n, 3000, [(200, 3700, "a"), (300, 3800, "c"), (5000, 6900, "d")])
    # the same text is not told again; each of the two pending is met by one segment
    assert [(i, t, f) for i, _, _, t, f in out] == [(3, "d", False), (1, "a", True), (2, "c", True)]
    assert [p["id"] for p in pending] == [3] and n == 3


def test_alert_stream_equals_the_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(c, rng.randrange(600_000), f"{rng.choice([-90, -40, 0, 50, 90]) / 100}", f"{rng.randrange(65, 99) / 100}", False) for c in (1, 2, 3) for _ in range(300)]
    rows.sort(key=lambda r: r[1])
    schema = "call_id long, start_ms long, score string, prob string, ended boolean"
    parts = [rows[i : i + 150] for i in range(0, len(rows), 150)] + [[(c, None, None, None, True) for c in (1, 2, 3)]]
    got = streamed(spark, tmp_path, schema, parts, windows.alerts)
    want = sentiment.alerts(spark.createDataFrame(rows, schema).drop("ended")).collect()
    assert sorted(got) == sorted(map(tuple, want)) and len(got) > 3


def test_first_finals_and_sessions_as_streams(spark, tmp_path):
    schema = "call_id string, utterance_id string, is_final boolean, ts timestamp"
    at = lambda m: __import__("datetime").datetime(2024, 1, 1, 0, m)
    batches = [[("c", "u", False, at(0)), ("c", "u", True, at(1))], [("c", "u", True, at(2)), ("c", "v", True, at(3))]]
    got = streamed(spark, tmp_path, schema, batches, frames.first_finals)
    assert sorted(r[1] for r in got) == ["u", "v"]
    events = [[("k", at(0)), ("k", at(0))], [("k", at(10))], [("k", at(30))]]
    (tmp_path / "s").mkdir()
    got = streamed(spark, tmp_path / "s", "key string, ts timestamp", events, frames.sessions)
    assert [r[3] for r in got][:2] == [2, 1]


GOOD = {"case_id": "case-1", "excluded": False, "abstained": False, "gold_findings": [{"rule_id": "r1", "critical": True}], "predicted_findings": [{"rule_id": "r1", "status": "UNKNOWN"}], "gold_dimensions": {"a": 3}, "predicted_dimensions": {"a": 5}}
WRONG = [
    ({"more": 1}, "fields"), ({"gold_findings": [{"rule_id": "r1", "critical": True, "x": 1}]}, "fields"), ({"case_id": "case-" + "x" * 130}, "identifier"), ({"case_id": "case-a b"}, "identifier"), ({"excluded": "yes"}, "flags"), ({"gold_findings": None}, "findings"),
    ({"gold_findings": [{"rule_id": "r", "critical": True}] * 2}, "rules"), ({"predicted_findings": [{"rule_id": "-", "status": "UNKNOWN"}]}, "rules"), ({"predicted_findings": [{"rule_id": "r", "status": "MAYBE"}]}, "labels"), ({"gold_findings": [{"rule_id": "r", "critical": 1}]}, "labels"),
    ({"gold_dimensions": {"a b": 1}}, "dimensions"), ({"gold_dimensions": {f"d{i}": 1 for i in range(33)}}, "dimensions"), ({"predicted_dimensions": {"a": 0.5}}, "scores"), ({"predicted_dimensions": {"a": "x"}}, "dimensions"),
]


def test_every_fault_of_an_evaluation_case(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    rows = [GOOD, *(GOOD | {"case_id": f"case-{i:03}"} | change for i, (change, _) in enumerate(WRONG))]
    path.write_text("\n\n".join(json.dumps(r) for r in rows))
    got = dict(tuple(r) for r in files.case_faults(files.evaluation_cases(spark, str(path))).collect())
    assert got == {r["case_id"]: fault for r, (_, fault) in zip(rows[1:], WRONG)}


def test_limits_of_an_evaluation_file(spark, tmp_path, monkeypatch):
    path = tmp_path / "cases.jsonl"
    path.write_text("\n".join(json.dumps(GOOD | {"case_id": f"case-{i}"}) for i in range(5)))
    assert files.evaluation_cases(spark, str(path)).count() == 5 and len(files.file_digest(spark, str(path))) == 64
    monkeypatch.setattr(files, "MAX_CASES", 4)
    with pytest.raises(files.SourceError):
        files.evaluation_cases(spark, str(path))
    path.write_text("no json")
    with pytest.raises(Exception, match="no JSON object"):
        files.evaluation_cases(spark, str(path)).collect()


@pytest.mark.parametrize("change,fault", [
    ({"more": 1}, "more: unknown field"), ({"config_id": "x"}, "config_id"), ({"version": True}, "version"), ({"version": 2**31}, "version"), ({"identity": []}, "identity: an object"), ({"identity": {"use_case_id": "ab", "x": 1}}, "identity.x"),
    ({"identity": {"use_case_id": "ab", "display_name": " "}}, "display_name"), ({"schema_version": "2"}, "schema_version"), ({"questions": {}}, "questions: none"), ({"output": {"Token": 1}}, "Token"), ({"output": {"a": "x" * 17_000}}, "longer than"), ({"output": {"a": 2**63}}, "64 bits"), ({"output": {"a": "${b}"}}, "templates"),
])
def test_faults_of_a_configuration(change, fault):
    assert disposition.compile_config(CONFIG)
    with pytest.raises(disposition.ConfigError) as e:
        disposition.compile_config(CONFIG | change)
    assert any(fault in x for x in e.value.errors)


def test_rule_set_and_rubric_are_checked():
    rubric = {"schema_version": "1", "rubric_version": "v1", "pass_threshold": 3.5, "dimensions": [{"id": d, "weight": w, "anchors": ["a", "b", "c"]} for d, w in audit.WEIGHTS.items()]}
    assert len(audit.compile_rubric(rubric)["rubric_hash"]) == 64
    for bad in ({"pass_threshold": 6}, {"dimensions": rubric["dimensions"][1:]}):
        with pytest.raises(ValueError):
            audit.compile_rubric(rubric | bad)


def test_report_file(spark, tmp_path):
    files.write_report(spark.sql("select 2 b, named_struct('z', 'ä', 'y', 1) a"), str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text(encoding="utf-8") == '{\n  "a": {\n    "y": 1,\n    "z": "ä"\n  },\n  "b": 2\n}\n'


def test_export_file(spark, tmp_path):
    rows = spark.createDataFrame([("a,b", "'=1"), ("c", "")], "x string, y string")
    assert reports.exported(rows, str(tmp_path / "e.csv")) == 2
    assert (tmp_path / "e.csv").read_bytes() == b'x,y\r\n"a,b",\'=1\r\nc,\r\n'
    with pytest.raises(ValueError):
        reports.exported(rows, str(tmp_path / "e.csv"), limit=1)


@pytest.mark.parametrize("limit", [0, 101])
def test_limits_of_the_queue(spark, limit):
    with pytest.raises(ValueError):
        reports.review_queue(*[view(spark, SF, n) for n in ("v_calls", "v_audits", "v_reviews")], Scope("org-1", "qa", "QA_ANALYST"), limit)


def test_wav_files_of_other_makers(spark):
    import io
    import wave

    def made(channels, rate, n, width=2):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(width)
            w.setframerate(rate)
            w.writeframes(b"\0" * n)
        return out.getvalue()

    whole = made(2, 16000, 64000)
    extra = whole[:12] + b"LIST\x04\0\0\0abcd" + whole[12:]
    cases = [(whole, (16000, 2, 1000, None)), (extra, (16000, 2, 1000, None)), (whole[:-2], (16000, 2, 1000, "TRUNCATED")), (made(3, 8000, 6000), (8000, 3, 125, "PROPERTIES")), (b"RIFF", (None, None, None, "FORMAT")), (b"", (None, None, None, "SIZE")), (None, (None, None, None, "SIZE"))]
    got = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, f binary").select("i", media.inspected(F.col("f")).alias("w")).orderBy("i").select("w.*").collect()
    assert [tuple(r) for r in got] == [w for _, w in cases]
    pcm = bytes(range(16))
    own = spark.createDataFrame([(pcm,)], "p binary").select(media.wav(F.col("p")).alias("w")).first()["w"]
    assert bytes(own) == made(1, 8000, 16)[:-16] + pcm


def test_attribution_of_misses(spark):
    rows = [(1, "please hold the line now", [("u1", "please hold"), ("u2", "a line")]), (2, "", []), (3, None, [("u", "x")])]
    got = wer.attributions(spark.createDataFrame(rows, "call_id long, reference string, utterances array<struct<id:string,text:string>>"))
    assert [tuple(r)[2:] for r in got.filter("call_id = 1").orderBy("position").collect()] == [("u1", "match", "please", "please"), ("u1", "match", "hold", "hold"), ("u2", "substitute", "the", "a"), ("u2", "match", "line", "line"), (None, "delete", "now", None)]
    assert [tuple(r)[2:] for r in got.filter("call_id <> 1").collect()] == [("u", "insert", None, "x")]


def test_pairs_beyond_the_limit_have_no_counts(spark):
    pairs = spark.createDataFrame([(1, "a " * (wer.MAX_WORDS + 1), "a"), (2, "a b", "a")], "call_id long, reference string, hypothesis string")
    assert [tuple(r) for r in wer.error_counts(pairs).orderBy("call_id").collect()] == [(1, wer.MAX_WORDS + 1, None, None, None, None, None), (2, 2, 1, 0, 1, 0, 0.5)]


def test_redaction_of_texts_with_and_without_a_hint(spark):
    texts = [None, "", "nothing here", "I AM Jane Doe", "ſupport", "١٢٣٤٥٦٧٨٩", "mail a@b.co", "Member No ABCDE", "my name is Bob", "lives at 5 Main Street", "tel (030) 1234-5678"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", privacy.redactor()(F.col("t")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == [privacy.redacted(t) for t in texts]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", privacy.redactor()(F.col("text")).alias("safe")).collect()
    assert all(privacy.redacted(r["text"]) == r["safe"] for r in docs) and any(r["safe"] != r["text"] for r in docs)


def test_redacted_turns_equal_plain_redaction(spark):
    want = {(r["conv_id"], r["turn"]): privacy.redacted(r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    assert {(r["conv_id"], r["turn"]): r["safe"] for r in QUERIES["redacted_turns"](spark, SF).collect()} == want
