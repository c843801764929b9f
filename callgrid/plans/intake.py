"""Queries over intake, media, live windows and answers of models."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from callgrid.functions import text
from callgrid.operators import intake, media, responses
from callgrid.plans.catalog import query
from callgrid.sources import files
from callgrid.sources.derived import view
from callgrid.streaming import windows

NOW = 1706572800000000  # the time that stands for now, in microseconds


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("cursor_texts", "with c as (select event_id, case event_id % 6 when 0 then null when 1 then cast(event_id as varchar) when 2 then '-1' when 3 then '9223372036854775807' when 4 then '9223372036854775808' else '1 ' end raw from events) select event_id, case when raw is null then 0 when regexp_full_match(raw, '[0-9]{1,19}') then try_cast(raw as bigint) end as cursor from c")
def cursor_texts(spark, sf_dir):
    i = F.col("event_id")
    raw = F.when(i % 6 == 1, i.cast("string")).when(i % 6 == 2, "-1").when(i % 6 == 3, "9223372036854775807").when(i % 6 == 4, "9223372036854775808").when(i % 6 == 5, "1 ")
    return _table(spark, sf_dir, "events").select("event_id", intake.cursor(raw).alias("cursor"))


_PAYLOAD = """case c_custkey % 7 when 0 then '{"processing_state":"' || c_mktsegment || '","transcript_revision":' || c_custkey || '}' when 1 then '{"processing_state":"READY","transcript_revision":"1"}' when 2 then '{"processing_state":"READY"}'
  when 3 then '{"processing_state":"READY","transcript_revision":-1}' when 4 then '{"transcript_revision":2,"processing_state":"READY","more":1}' when 5 then 'no json' else '{"transcript_revision":0,"processing_state":"READY"}' end"""


@query("payload_checks", f"with p as (select c_custkey, {_PAYLOAD} j from customer) select c_custkey, case when json_valid(j) then coalesce(list_sort(json_keys(j)) = ['processing_state', 'transcript_revision'] and json_type(j, '$.processing_state') = 'VARCHAR' and json_type(j, '$.transcript_revision') in ('UBIGINT', 'BIGINT') and regexp_full_match(j ->> '$.transcript_revision', '0|[1-9][0-9]*'), false) else false end fits from p")
def payload_checks(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(_PAYLOAD).alias("j"))
    return rows.select("c_custkey", intake.payload_fits(F.col("j")).alias("fits"))


@query("transcription_states", "select user_id session_id, case when count(*) filter (where event_type = 'error') > 0 then 'DEGRADED' else 'LIVE' end state from events group by 1")
def transcription_states(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.when(F.col("event_type") == "error", "DEGRADED").otherwise("LIVE").alias("state"))
    return intake.transcription_states(e)


_CONFIG_EVENTS = "select concat('org-', cast(cast(substr(config_id, 5) as int) % 5 as varchar(9))) organisation_id, config_id, version, case when action = 'STAGED' and at_ % 2 = 0 then 'ROLLBACK' else action end action, actor, at_ from v_config_events"
_POINTERS = f"ce as ({_CONFIG_EVENTS}), p as (select * from (select *, row_number() over (partition by organisation_id order by at_ desc, config_id desc, version desc) r, count(*) over (partition by organisation_id) generation from ce where action in ('ACTIVATED', 'ROLLBACK')) x where r = 1)"


def _config_events(spark, sf_dir):
    e = view(spark, sf_dir, "v_config_events")
    org = F.concat(F.lit("org-"), (F.substring("config_id", 5, 9).cast("int") % 5).cast("string"))
    return e.withColumns({"organisation_id": org, "action": F.when((F.col("action") == "STAGED") & (F.col("at_") % 2 == 0), "ROLLBACK").otherwise(F.col("action"))})


@query("config_pointers", f"with {_POINTERS} select organisation_id, config_id, version, generation from p")
def config_pointers(spark, sf_dir):
    return intake.config_pointers(_config_events(spark, sf_dir))


@query("rollback_targets", f"with {_POINTERS} select distinct e.organisation_id, e.config_id, e.version from ce e where action in ('ACTIVATED', 'ROLLBACK') and exists (select 1 from ce a join v_versions v on v.config_id = a.config_id and v.version = a.version where a.action = 'APPROVED' and a.config_id = e.config_id and a.version = e.version and a.actor <> v.actor)")
def rollback_targets(spark, sf_dir):
    org = F.concat(F.lit("org-"), (F.substring("config_id", 5, 9).cast("int") % 5).cast("string"))
    return intake.rollback_targets(_config_events(spark, sf_dir), view(spark, sf_dir, "v_versions").withColumn("organisation_id", org))


@query("active_configs", f"with {_POINTERS} select c.call_id, p.config_id, p.version, v.actor, c.transcript_revision from v_calls c join p on p.organisation_id = c.organisation_id join v_versions v on v.config_id = p.config_id and v.version = p.version where c.tombstoned_at is null")
def active_configs(spark, sf_dir):
    pointers = intake.config_pointers(_config_events(spark, sf_dir))
    return intake.active_configs(view(spark, sf_dir, "v_calls"), pointers, view(spark, sf_dir, "v_versions")).select("call_id", "config_id", "version", "actor", "transcript_revision")


@query(
    "intake_fences",
    """with s as (select organisation_id, session_id % 3 integration_id, session_id call_key, 1 + session_id % 4 generation, state, agent_id, team_id from v_sessions),
      m as (select organisation_id, agent_id, min(team_id) team, count(*) n from (select distinct organisation_id, agent_id, team_id from s where call_key % 9 > 0 and call_key % 20 = cast(substr(agent_id, 7) as int) + 10 * cast(call_key % 20 >= 10 as int) and call_key < 60) x group by 1, 2)
      select s.call_key, case when state <> 'DRAINING' or integration_id = 2 or generation <> 1 + call_key % 2 then 'STALE' when coalesce(n = 1 and m.team = s.team_id, false) then 'OK' else 'NOT_MEMBER' end outcome
      from s left join m on m.organisation_id = s.organisation_id and m.agent_id = s.agent_id""",
)
def intake_fences(spark, sf_dir):
    s = view(spark, sf_dir, "v_sessions").withColumns({"integration_id": F.col("session_id") % 3, "call_key": F.col("session_id"), "generation": F.col("session_id") % 4 + 1, "agent_ref": F.concat(F.lit("ref-"), "agent_id")})
    asked = s.select("organisation_id", "integration_id", "call_key", (F.col("call_key") % 2 + 1).alias("generation"), "agent_ref", "agent_id", "team_id")
    integrations = s.select("organisation_id", "integration_id", (F.col("integration_id") != 2).alias("is_active")).distinct()
    mappings = s.select("organisation_id", "integration_id", "agent_ref", "agent_id", "team_id").distinct()
    chosen = F.expr("call_key % 9 > 0 and call_key % 20 = cast(substr(agent_id, 7) as int) + 10 * cast(call_key % 20 >= 10 as int) and call_key < 60")
    members = s.filter(chosen).select("organisation_id", F.col("agent_id").alias("user_id"), "team_id").distinct().withColumns({"role": F.lit("AGENT"), "is_active": F.lit(True)})
    return intake.fenced(asked, s, integrations, mappings, members).select("call_key", "outcome")


_STAGED = "select distinct call_id, stage, attempts input_revision from v_jobs"


@query("stage_jobs", f"with j as ({_STAGED}), d as (select distinct call_id, stage, attempts input_revision from v_jobs where state = 'DONE' and job_id % 5 > 0), n as (select call_id, s.stage, input_revision + 1 input_revision from d, (values ('ANALYSE'), ('POLICY')) s(stage) where d.stage = 'TRANSCRIBE' union select call_id, 'AUDIT', input_revision from d where stage = 'POLICY') select * from n where not exists (select 1 from j where j.call_id = n.call_id and j.stage = n.stage and j.input_revision = n.input_revision)")
def stage_jobs(spark, sf_dir):
    jobs = view(spark, sf_dir, "v_jobs").withColumnRenamed("attempts", "input_revision")
    return intake.stage_jobs(jobs.filter("state = 'DONE'").withColumn("usable", F.col("job_id") % 5 > 0), jobs)


@query("processed_jobs", "select job_id, stage, case stage when 'TRANSCRIBE' then 'ANALYSING' when 'ANALYSE' then 'NEEDS_REVIEW' else 'NEEDS_REVIEW' end processing_state from v_jobs where state = 'RUNNING'")
def processed_jobs(spark, sf_dir):
    ends = {"TRANSCRIBE": "ANALYSING", "ANALYSE": "NEEDS_REVIEW", "POLICY": "NEEDS_REVIEW"}
    stages = {name: (lambda df, to=to: df.select("job_id", "stage", F.lit(to).alias("processing_state"))) for name, to in ends.items()}
    return intake.processed(view(spark, sf_dir, "v_jobs").filter("state = 'RUNNING'"), stages)


@query("purged_calls", "select call_id, case when g then 'deleted:' || call_id else 'ref-' || call_id end external_ref, case when g then repeat('0', 64) else sha256(cast(call_id as varchar)) end payload_sha256, case when g then '[deleted]' else agent_id end agent_id, case when g then '[deleted]' else team_id end team_id, case when g then 'DELETED' else processing_state end processing_state from (select *, tombstoned_at is not null and call_id % 4 > 0 and call_id % 5 > 0 g from v_calls) c")
def purged_calls(spark, sf_dir):
    calls = view(spark, sf_dir, "v_calls").withColumns({"external_ref": F.concat(F.lit("ref-"), F.col("call_id").cast("string")), "payload_sha256": F.sha2(F.col("call_id").cast("string"), 256), "legal_hold": F.col("call_id") % 4 == 0})
    return intake.purged(calls, calls.filter("call_id % 5 > 0")).select("call_id", "external_ref", "payload_sha256", "agent_id", "team_id", "processing_state")


@query("live_buffer", f"with b as (select user_id session_id, start_ms utterance_id, event_type text, us + 900000000 expires_us from (select *, row_number() over (partition by user_id, start_ms order by us, event_id) r from v_event_ms) x where r = 1) select session_id, utterance_id, case when utterance_id % 3 = 0 then 'again' else text end as text, case when utterance_id % 3 = 0 then {NOW} + 900000000 else expires_us end expires_us from b where utterance_id % 3 = 0 or expires_us > {NOW}")
def live_buffer(spark, sf_dir):
    e = view(spark, sf_dir, "v_event_ms").groupBy(F.col("user_id").alias("session_id"), F.col("start_ms").alias("utterance_id")).agg(F.min_by(F.struct("event_type", "us"), F.struct("us", "event_id")).alias("f"))
    there = e.select("session_id", "utterance_id", F.col("f.event_type").alias("text"), (F.col("f.us") + 900_000_000).alias("expires_us"))
    return intake.buffered(there, there.filter("utterance_id % 3 = 0").select("session_id", "utterance_id", F.lit("again").alias("text")), NOW)


@query("live_reads", f"with u as (select user_id session_id, 1 + event_id % 2 generation, start_ms, event_id from v_event_ms where us + 86400000000 > {NOW}), r as (select *, row_number() over (partition by session_id, generation order by start_ms desc, event_id desc) k from u) select s.session_id, count(r.event_id) n, min(r.start_ms) first_ms, max(r.event_id) last_id from v_sessions s left join r on r.session_id = s.session_id and r.generation = 1 + s.session_id % 2 and k <= 500 group by 1")
def live_reads(spark, sf_dir):
    u = view(spark, sf_dir, "v_event_ms").select(F.col("user_id").alias("session_id"), (F.col("event_id") % 2 + 1).alias("generation"), "start_ms", F.col("event_id").alias("utterance_id"), (F.col("us") + 86_400_000_000).alias("expires_us"))
    s = view(spark, sf_dir, "v_sessions").select("session_id", (F.col("session_id") % 2 + 1).alias("generation"))
    read = intake.live_read(s, u, NOW)
    return read.select("session_id", F.size("rows").cast("long").alias("n"), F.array_min("rows.start_ms").alias("first_ms"), F.array_max("rows.utterance_id").alias("last_id"))


@query("review_writes", "with h as (select audit_id, max(version) v from v_reviews group by 1), q as (select audit_id * 2 + k request_id, audit_id, (audit_id % 3)::int expected from v_audits, (values (0), (1)) t(k)), f as (select q.audit_id, min(request_id) first from q left join h on h.audit_id = q.audit_id where expected = coalesce(v, 0) group by 1) select q.request_id, q.audit_id, case when q.request_id = f.first then 'WRITTEN' else 'CONFLICT' end outcome, case when q.request_id = f.first then coalesce(v, 0) + 1 end as version from q left join h on h.audit_id = q.audit_id left join f on f.audit_id = q.audit_id")
def review_writes(spark, sf_dir):
    a = view(spark, sf_dir, "v_audits").select("audit_id", (F.col("audit_id") % 3).cast("int").alias("expected_version"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    return intake.reviewed(a.withColumn("request_id", F.col("audit_id") * 2 + F.col("k")), view(spark, sf_dir, "v_reviews"))


@query("wav_files", "select doc_id, case when n > 0 then 8000 end rate, case when n > 0 then 1 end channels, case when n > 0 then (n // 16) + case when n % 16 > 8 or (n % 16 = 8 and (n // 16) % 2 = 1) then 1 else 0 end end::int duration_ms, case when n = 0 then 'SIZE' when (n // 16) + case when n % 16 > 8 or (n % 16 = 8 and (n // 16) % 2 = 1) then 1 else 0 end = 0 then 'PROPERTIES' end fault from (select doc_id, 2 * strlen(coalesce(text, '')) n from documents) d")
def wav_files(spark, sf_dir):
    pcm = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    d = _table(spark, sf_dir, "documents").select("doc_id", media.inspected(media.wav(F.concat(pcm, pcm))).alias("w"))
    return d.select("doc_id", "w.*")


_MEDIA = """concat('{"event":"media","sequence_number":', case when event_id % 3 = 0 then concat('"', event_id + 1, '"') else cast(event_id + 1 as varchar(20)) end, ',"stream_sid":"s', user_id, '","media":{"chunk":', event_id + case when event_id % 19 = 0 then 0 else 1 end * 1, ',"timestamp":"', event_id * 20, '","payload":"', case event_id % 11 when 0 then 'AAA' when 1 then '' else 'AAECAwQFBgc=' end, '"}}')"""
_ENVELOPE = f"case event_id % 13 when 0 then '{{\"event\":\"connected\"}}' when 1 then 'no json' when 2 then '{{\"event\":\"pause\"}}' when 3 then concat('{{\"event\":\"stop\",\"sequence_number\":', event_id + 1, ',\"stream_sid\":\"s', user_id, '\",\"stop\":{{}}}}') else {_MEDIA} end"


@query(
    "media_envelopes",
    f"""with e as (select event_id, {_ENVELOPE} v from events) select event_id, case event_id % 13 when 0 then 'connected' when 1 then null when 2 then 'pause' when 3 then 'stop' else 'media' end kind,
      case when event_id % 13 > 2 then event_id + 1 end as sequence, case when event_id % 13 > 3 then case event_id % 11 when 0 then null when 1 then 0 else 8 end end n_bytes,
      case when event_id % 13 = 1 then 'NOT_JSON' when event_id % 13 = 2 then 'KIND' when event_id % 13 <= 3 then null when event_id = 0 then 'CHUNK' when event_id * 20 > 7200000 then 'TIMESTAMP' when event_id % 11 <= 1 then 'PAYLOAD' end fault from e""",
)
def media_envelopes(spark, sf_dir):
    lines = _table(spark, sf_dir, "events").select("event_id", F.expr(_ENVELOPE).alias("value"))
    return media.envelopes(lines).select("event_id", "kind", "sequence", "n_bytes", "fault")


@query(
    "opaque_frames",
    """with f as (select session_id, event_id, us, case when event_id % 97 = 0 then 0 else bytes end n_bytes from v_frames),
      r as (select *, case when n_bytes = 0 then 'FRAME' when us - min(us) over (partition by session_id) > 7200000000 then 'TOO_LONG' else 'OK' end own from f),
      b as (select *, sum(case when own <> 'OK' then 1 else 0 end) over (partition by session_id order by us, event_id rows between unbounded preceding and 1 preceding) broken from r)
      select session_id, event_id, case when coalesce(broken, 0) > 0 then 'CLOSED' else own end status from b""",
)
def opaque_frames(spark, sf_dir):
    f = view(spark, sf_dir, "v_frames").withColumn("n_bytes", F.when(F.col("event_id") % 97 == 0, 0).otherwise(F.col("bytes")))
    return media.opaque_frames(f).select("session_id", "event_id", "status")


@query("live_windows", "select user_id, w.k * 3000 window_ms, count(*) n from v_event_ms e join (select unnest(range(0, 200000)) k) w on w.k * 3000 <= e.start_ms and e.start_ms < w.k * 3000 + 4000 where e.start_ms >= 0 group by 1, 2")
def live_windows(spark, sf_dir):
    frames = view(spark, sf_dir, "v_event_ms").filter("start_ms >= 0").select("user_id", "start_ms")
    return windows.overlapping(frames).groupBy("user_id", "window_ms").agg(F.count(F.lit(1)).alias("n"))


_CLASSES = {"label_2": "c_custkey % 101", "neutral": "100 - c_custkey % 101 - (100 - c_custkey % 101) div 2", "NEG ": "(100 - c_custkey % 101) div 2"}


@query("class_signals", "with c as (select c_custkey, c_custkey % 101 p, (100 - c_custkey % 101) // 2 n, c_custkey % 7 k from customer) select c_custkey, case when k > 1 then (p - n) / 100.0::double end score, case when k > 1 then greatest(p, n, 100 - p - n) / 100.0::double end prob from c")
def class_signals(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    # a repeated label and a sum too large are no answer
    label = lambda name: F.when((F.col("c_custkey") % 7 == 0) & F.lit(name == "neutral"), "neg").otherwise(name)
    extra = F.when(F.col("c_custkey") % 7 == 1, 0.5).otherwise(0.0)
    classes = F.array(*[F.struct(label(name).alias("label"), (F.expr(share) / 100 + (extra if name == "neutral" else 0)).alias("score")) for name, share in _CLASSES.items()])
    return c.select("c_custkey", responses.class_signal(classes).alias("s")).select("c_custkey", F.round("s.score", 9).alias("score"), F.round("s.prob", 9).alias("prob"))


def _response(call: str, dims: list[str]) -> str:
    """SQL of a response in JSON, as both dialects read it; its faults follow from the call's number."""
    one = lambda i, d: f"""'{{"id":"{d}","status":"' || case when {call} % 11 = {i} then 'INSUFFICIENT_EVIDENCE' when {call} % 13 = 12 and '{d}' = 'objection' then 'NOT_APPLICABLE' else 'SCORED' end || '","score":' || case when {call} % 11 = {i} or ({call} % 13 = 12 and '{d}' = 'objection') then 'null' when {call} % 17 = 3 and {i} = 2 then '7' else cast(1 + ({call} + {i}) % 5 as varchar(2)) end || ',"reason":"' || case when {call} % 19 = 4 and {i} = 5 then ' ' else 'heard' end || '","evidence":[' || case when {call} % 11 = {i} or ({call} % 13 = 12 and '{d}' = 'objection') then '' else '{{"utterance_id":"u' || {call} || '","quote":"' || case when {call} % 23 = 5 and {i} = 1 then 'never said' else 'good day' end || '"}}' end || ']}}'"""
    return f"""case when {call} % 29 = 6 then '{{"dimensions":[]}}' when {call} % 31 = 7 then 'no json' else '{{"dimensions":[' || {" || ',' || ".join(one(i, d) for i, d in enumerate(dims))} || '],"coaching_narrative":{{"text":"well","evidence":[{{"utterance_id":"u' || {call} || '","quote":"day"}}]}},"highlights":[],"improvement_areas":' || case when {call} % 37 = 8 then '[{{"text":"more","evidence":[]}}]' else '[]' end || '}}' end"""


_DIMS = list(responses.WEIGHTS)
_W = list(responses.WEIGHTS.values())
_GIVEN = lambda i: f"1 + (k + {i}) % 5"


@query(
    "audit_responses",
    f"""with c as (select c_custkey k from customer), f as (select k, case when k % 29 = 6 or k % 31 = 7 then 'INVALID_SCHEMA'
        {" ".join(f"when {'k % 23 = 5 and k % 11 <> 1' if i == 1 else 'false'} then 'INVALID_EVIDENCE' when {'k % 19 = 4' if i == 5 else 'false'} then 'INVALID_REASON' when {'k % 17 = 3 and k % 11 <> 2' if i == 2 else 'false'} then 'SCORE_REQUIRES_EVIDENCE' when {'k % 13 = 12 and k % 11 <> 5 and k % 2 = 0' if i == 5 else 'false'} then 'UNVERIFIED_NOT_APPLICABLE'" for i in range(7))}
        when k % 37 = 8 then 'NARRATIVE_REQUIRES_EVIDENCE' end fault from c)
      select k call_id, fault, case when fault is null and k % 11 >= 7 then round(({" + ".join(f"({_GIVEN(i)}) * {w}" if i != 5 else f"case when k % 13 = 12 then 0 else ({_GIVEN(i)}) * {w} end" for i, w in enumerate(_W))})::double / (case when k % 13 = 12 then 90 else 100 end), 2) end overall_score from f""",
)
def audit_responses(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("call_id"), F.expr(_response("c_custkey", _DIMS)).alias("response"), (F.col("c_custkey") % 2 == 1).alias("objection_absent"))
    said = c.select("call_id", F.concat(F.lit("u"), F.col("call_id").cast("string")).alias("id"), F.lit("AGENT").alias("role"), F.lit(True).alias("is_final"), F.lit("a good day to you").alias("text"))
    return responses.checked_responses(c, said).select("call_id", "fault", F.col("overall_score").cast("double").alias("overall_score"))


def _judge(payload: str, fault: str | None) -> str | None:
    """Stands for a local model: by the payload's number it answers at once, after the fault is told, or never."""
    asked = json.loads(payload)
    return asked["answer"] if asked["kind"] == 0 or asked["kind"] == 1 and fault else None if asked["kind"] == 3 else "no json"


@query("audit_attempts", "select c_custkey call_id, case c_custkey % 4 when 2 then 'INVALID_MODEL_OUTPUT' when 3 then 'LOCAL_INFERENCE_UNAVAILABLE' end fault, case c_custkey % 4 when 0 then 1 when 3 then 3 else 2 end::int attempts from customer")
def audit_attempts(spark, sf_dir):
    """Answers of a model with one repair and three attempts at most."""
    good = {"dimensions": [{"id": d, "status": "SCORED", "score": 4, "reason": "heard", "evidence": [{"utterance_id": "u", "quote": "good"}]} for d in _DIMS], "coaching_narrative": {"text": "well", "evidence": [{"utterance_id": "u", "quote": "day"}]}, "highlights": [], "improvement_areas": []}
    payload = F.to_json(F.struct((F.col("c_custkey") % 4).alias("kind"), F.lit(json.dumps(good)).alias("answer")))
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("call_id"), payload.alias("payload"), F.lit(False).alias("objection_absent"))
    said = c.select("call_id", F.lit("u").alias("id"), F.lit("AGENT").alias("role"), F.lit(True).alias("is_final"), F.lit("a good day").alias("text"))
    return responses.audited(c, said, _judge).select("call_id", "fault", "attempts")


_CASE = """concat('{"case_id":"', case when c_custkey % 13 = 1 then 'x-' else 'case-' end, c_custkey, '","excluded":', case when c_custkey % 17 = 2 then 'true' else 'false' end, ',"abstained":', case when c_custkey % 17 = 2 then 'true' else 'false' end,
  ',"gold_findings":[{"rule_id":"r1","critical":true}', case when c_custkey % 19 = 3 then ',{"rule_id":"r1","critical":false}' else '' end, '],"predicted_findings":[{"rule_id":"r1","status":"', case when c_custkey % 23 = 4 then 'MAYBE' else 'UNKNOWN' end,
  '"}],"gold_dimensions":{"', case when c_custkey % 29 = 5 then 'a b' else 'a' end, '":', case when c_custkey % 31 = 6 then '9' else '4.5' end, '},"predicted_dimensions":{}', case when c_custkey % 11 = 0 then ',"more":1' else '' end, '}')"""


@query("case_faults", "select case when k % 13 = 1 then 'x-' else 'case-' end || k case_id, case when k % 11 = 0 then 'fields' when k % 13 = 1 then 'identifier' when k % 17 = 2 then 'flags' when k % 19 = 3 then 'rules' when k % 23 = 4 then 'labels' when k % 29 = 5 then 'dimensions' when k % 31 = 6 then 'scores' end fault from (select c_custkey k from customer) c where fault is not null")
def case_faults(spark, sf_dir):
    """Faults of evaluation cases, from their lines of JSON."""
    # keys are few bytes and their lines much work, so a small file is dealt to all cores first
    keys = _table(spark, sf_dir, "customer").select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    lines = keys.select(F.expr(_CASE).alias("raw"))
    return files.case_faults(files.parsed_cases(lines))


@query("event_frames", """select event_id, 'id: ' || event_id || chr(10) || 'event: call.updated' || chr(10) || 'data: {"call_id":' || user_id || ',"state":"' || event_type || '"}' || chr(10) || chr(10) frame from events""")
def event_frames(spark, sf_dir):
    payload = F.struct(F.col("user_id").alias("call_id"), F.col("event_type").alias("state"))
    return _table(spark, sf_dir, "events").select("event_id", files.event_frame(F.col("event_id"), F.lit("call.updated"), payload).alias("frame"))


@query("event_times", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(ts) % 1000000 = 0 then '' else strftime(ts, '.%f') end || 'Z' at_ from events")
def event_times(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", text.iso_utc(F.col("ts").cast("timestamp"), "Z").alias("at_"))


_PURGED = "select call_id from v_calls where tombstoned_at is not null and call_id % 4 > 0 and call_id % 5 > 0"


@query(
    "purged_tables",
    " union all ".join(
        f"select '{name}' kind, count(*) n, count(*) filter (where {key} in ({_PURGED})) n_purged, count(*) {after} n_after from {table}"
        for name, table, key, after in [("calls", "v_calls", "call_id", ""), ("findings", "v_findings", "call_id", f"filter (where call_id not in ({_PURGED}))"), ("jobs", "v_jobs", "call_id", f"filter (where call_id not in ({_PURGED}))"), ("live_rows", "v_event_ms", "user_id", f"filter (where user_id not in ({_PURGED}))"), ("sessions", "v_sessions", "session_id", ""), ("audits", "v_audits", "call_id", ""), ("reviews", "v_reviews", "call_id", "")]
    ),
)
def purged_tables(spark, sf_dir):
    """Every table after the purge of the calls that are tombstoned, due and not on hold: rows before, rows of
    purged calls, rows written."""
    from callgrid.operators.retention import Purge
    from callgrid.session import work_dir

    v = lambda name: view(spark, sf_dir, name)
    as_of, i = F.to_timestamp(F.lit("2024-01-30 00:00:00")), F.col("call_id")
    none = F.lit(None).cast("timestamp")
    calls = v("v_calls").withColumns({"tombstoned_at": F.col("tombstoned_at").cast("timestamp"), "legal_hold": i % 5 == 0, "content_purged_at": none, "deletion_requested_at": F.when(i % 4 == 1, as_of), "retention_expires_at": F.when(i % 4 > 1, F.to_timestamp(F.lit("2024-01-01 00:00:00"))), "external_ref": F.concat(F.lit("ref-"), i.cast("string")), "payload_sha256": F.sha2(i.cast("string"), 256)})
    removed = {"findings": v("v_findings"), "jobs": v("v_jobs"), "live_rows": v("v_event_ms").withColumnRenamed("user_id", "call_id")}
    sessions = v("v_sessions").withColumnRenamed("session_id", "call_id").withColumn("content_purged_at", none)
    purge = Purge(calls, as_of, removed, {"sessions": sessions}, {"audits": v("v_audits"), "reviews": v("v_reviews")})
    path = f"{work_dir(spark)}/purge-{uuid.uuid4().hex}"
    counts = purge.write(path)
    rows = [(name, n, gone, spark.read.parquet(f"{path}/{name}").count()) for name, (n, gone) in counts.items()]
    return spark.createDataFrame(rows, "kind string, n long, n_purged long, n_after long")
