"""Intake, live sessions and retention: cursors, payload checks, fences, stage jobs and snapshots after a change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrid.operators.latest import newest, newest_n

# fixed values: rows of a live read, microseconds that a live row is kept, the digest of purged content
MAX_LIVE_ROWS, LIVE_TTL_US, NO_DIGEST = 500, 900_000_000, "0" * 64
#: Stages that follow a finished one, and by how much the transcript revision moves.
FOLLOWING = {"TRANSCRIBE": (("ANALYSE", "POLICY"), 1), "POLICY": (("AUDIT",), 0)}


def cursor(text: Column) -> Column:
    """A feed cursor from its text: 0 for null, and null for what is not a number of 1 to 19 ASCII digits
    that fits 63 bits."""
    return F.when(text.isNull(), F.lit(0).cast("long")).when(text.rlike(r"^[0-9]{1,19}\z"), text.try_cast("long"))


def payload_fits(payload: Column) -> Column:
    """Whether a JSON payload is an object of a text `processing_state` and a whole number
    `transcript_revision`, and nothing else."""
    parsed = F.try_parse_json(payload)
    kind = F.schema_of_variant(parsed).rlike(r"^OBJECT<processing_state: STRING, transcript_revision: (BIGINT|DECIMAL\([0-9]+,0\))>\z")
    return F.coalesce(kind & F.try_variant_get(parsed, "$.transcript_revision", "string").rlike(r"^(0|[1-9][0-9]*)\z"), F.lit(False))


def transcription_states(updates: DataFrame) -> DataFrame:
    """updates: session_id, state. The state of each session: DEGRADED once it was, else LIVE."""
    return updates.groupBy("session_id").agg(F.when(F.max(F.coalesce(F.col("state") == "DEGRADED", F.lit(False))), "DEGRADED").otherwise("LIVE").alias("state"))


def active_configs(calls: DataFrame, pointers: DataFrame, versions: DataFrame) -> DataFrame:
    """Calls that are not tombstoned with the version of the configuration that their tenant's pointer
    names. pointers: organisation_id, config_id, version; versions: config_id, version and what it holds."""
    active = pointers.join(versions, ["config_id", "version"])
    return calls.filter("tombstoned_at is null").join(active, "organisation_id")


def fenced(requests: DataFrame, sessions: DataFrame, integrations: DataFrame, mappings: DataFrame, members: DataFrame) -> DataFrame:
    """requests: organisation_id, integration_id, call_key, generation, agent_ref, agent_id, team_id. Adds
    outcome: STALE where session, active integration and agent mapping do not all say the same or the
    session does not drain in that generation; NOT_MEMBER where the agent has not exactly that one active
    team; else OK."""
    tenant = ["organisation_id", "integration_id"]
    live = sessions.filter("state = 'DRAINING'").select(*tenant, "call_key", "generation")
    held = integrations.filter("is_active").select(*tenant)
    mapped = mappings.select(*tenant, "agent_ref", "agent_id", "team_id")
    known = live.join(held, tenant).join(mapped, tenant).distinct().withColumn("_known", F.lit(True))
    teams = members.filter("is_active and role = 'AGENT'").groupBy("organisation_id", F.col("user_id").alias("agent_id")).agg(F.count(F.lit(1)).alias("_n"), F.min("team_id").alias("_team"))
    rows = requests.join(known, [*tenant, "call_key", "generation", "agent_ref", "agent_id", "team_id"], "left").join(teams, ["organisation_id", "agent_id"], "left")
    member = F.coalesce((F.col("_n") == 1) & (F.col("_team") == F.col("team_id")), F.lit(False))
    return rows.withColumn("outcome", F.when(F.col("_known").isNull(), "STALE").when(~member, "NOT_MEMBER").otherwise("OK")).drop("_known", "_n", "_team")


def stage_jobs(done: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs that follow finished ones and are not there yet: call_id, stage, input_revision. done: call_id,
    stage, input_revision, usable (a transcript without utterances leads nowhere)."""
    step = F.create_map(*[x for stage, (after, more) in FOLLOWING.items() for x in (F.lit(stage), F.struct(F.array(*map(F.lit, after)).alias("after"), F.lit(more).alias("more")))])
    to = done.filter("usable").withColumn("_to", F.try_element_at(step, F.col("stage"))).filter("_to is not null")
    new = to.select("call_id", F.explode("_to.after").alias("stage"), (F.col("input_revision") + F.col("_to.more")).alias("input_revision")).distinct()
    return new.join(jobs.select("call_id", "stage", "input_revision"), ["call_id", "stage", "input_revision"], "left_anti")


def processed(jobs: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The results of jobs, each by the function of its stage (all with the same columns); a stage without
    a function is an error, found before any is run."""
    if not stages:
        raise ValueError("no stage has a function")
    names = list(stages)
    checked = jobs.withColumn("stage", F.when(F.col("stage").isin(*names), F.col("stage")).otherwise(F.raise_error(F.concat(F.lit("no function for stage "), F.coalesce("stage", F.lit("null"))))))
    out = None
    for name, run in stages.items():
        part = run(checked.filter(F.col("stage") == name))
        out = part if out is None else out.unionByName(part)
    return out


def purged(calls: DataFrame, due: DataFrame) -> DataFrame:
    """The calls after a purge of those due that are tombstoned and not on hold: what tells about people
    and content is overwritten, the row stays."""
    gone = (F.col("_due").isNotNull()) & F.col("tombstoned_at").isNotNull() & ~F.coalesce("legal_hold", F.lit(False))
    rows = calls.join(due.select("call_id").distinct().withColumn("_due", F.lit(True)), "call_id", "left").withColumn("_gone", gone)
    marks = {"external_ref": F.concat(F.lit("deleted:"), F.col("call_id").cast("string")), "payload_sha256": F.lit(NO_DIGEST), "agent_id": F.lit("[deleted]"), "team_id": F.lit("[deleted]"), "processing_state": F.lit("DELETED")}
    return rows.withColumns({c: F.when(F.col("_gone"), mark).otherwise(F.col(c)) for c, mark in marks.items()}).drop("_due", "_gone")


def buffered(existing: DataFrame, batch: DataFrame, now_us: int, ttl_us: int = LIVE_TTL_US) -> DataFrame:
    """The live rows after a batch: by utterance the newest text, kept ttl_us longer; expired ones go."""
    both = existing.withColumn("_from", F.lit(0)).unionByName(batch.withColumn("expires_us", F.lit(now_us + ttl_us)).withColumn("_from", F.lit(1)))
    return newest(both, ["session_id", "utterance_id"], F.desc("_from")).drop("_from").filter(F.col("expires_us") > now_us)


def live_read(sessions: DataFrame, utterances: DataFrame, now_us: int, limit: int = MAX_LIVE_ROWS) -> DataFrame:
    """session_id, generation and rows: the unexpired utterances of the session's own generation, the
    newest `limit` by (start_ms, utterance_id), in order; none give an empty array."""
    fresh = newest_n(utterances.filter(F.col("expires_us") > now_us), ["session_id", "generation"], limit, F.desc("start_ms"), F.desc("utterance_id"))
    rows = fresh.groupBy("session_id", "generation").agg(F.array_sort(F.collect_list(F.struct("start_ms", "utterance_id"))).alias("rows"))
    joined = sessions.select("session_id", "generation").join(rows, ["session_id", "generation"], "left")
    return joined.withColumn("rows", F.coalesce("rows", F.array().cast(rows.schema["rows"].dataType)))


def reviewed(requests: DataFrame, heads: DataFrame) -> DataFrame:
    """requests: audit_id, expected_version. With the version that each would write, or outcome CONFLICT
    where the newest version (0 without a review) is another than expected; of several requests for one
    audit the first by request_id wins."""
    head = heads.groupBy("audit_id").agg(F.max("version").alias("_head"))
    rows = requests.join(head, "audit_id", "left").withColumn("_head", F.coalesce("_head", F.lit(0)))
    fits = rows.filter(F.col("expected_version") == F.col("_head")).groupBy("audit_id").agg(F.min("request_id").alias("_first"))
    rows = rows.join(fits, "audit_id", "left").withColumn("_ok", F.coalesce(F.col("request_id") == F.col("_first"), F.lit(False)))
    return rows.select("request_id", "audit_id", F.when(F.col("_ok"), "WRITTEN").otherwise("CONFLICT").alias("outcome"), F.when(F.col("_ok"), F.col("_head") + 1).alias("version"))


def config_pointers(events: DataFrame) -> DataFrame:
    """The active configuration of each tenant after its events (organisation_id, config_id, version,
    action, at_): that of the newest activation or rollback, and how many there were (generation)."""
    moves = events.filter("action in ('ACTIVATED', 'ROLLBACK')").groupBy("organisation_id")
    now = moves.agg(F.max_by(F.struct("config_id", "version"), F.struct("at_", "config_id", "version")).alias("now"), F.count(F.lit(1)).alias("generation"))
    return now.select("organisation_id", "now.*", "generation")


def rollback_targets(events: DataFrame, versions: DataFrame) -> DataFrame:
    """Versions that a tenant may go back to: once active, and approved by someone other than the author.
    versions: organisation_id, config_id, version, actor."""
    key = ["organisation_id", "config_id", "version"]
    was = events.filter("action in ('ACTIVATED', 'ROLLBACK')").select(*key)
    approved = events.filter("action = 'APPROVED'").select(*key, F.col("actor").alias("by"))
    other = versions.select(*key, "actor").join(approved, key).filter("by <> actor").select(*key)
    return was.join(other, key, "left_semi").distinct()
