"""Queries over sessions, frames and the event feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from callgrid.operators import intake, latest, operations
from callgrid.operators.scope import Scope
from callgrid.plans.catalog import query
from callgrid.sources.derived import view

NOW = 1706572800000000  # the time that stands for now, in microseconds
QA, LEADER = Scope("org-1", "qa", "QA_ANALYST"), Scope("org-1", "tl", "TEAM_LEADER", ("team-0", "team-3"))


@query(
    "live_calls",
    f"""select session_id, agent_id, team_id, state, cast(floor(({NOW} - updated_us) / 1000000) as bigint) age_s, state in ('LIVE', 'DRAINING') and floor(({NOW} - updated_us) / 1000000) > 45 stale from v_sessions s
      where organisation_id = 'org-1' and not purged and (state in ('LIVE', 'DRAINING') or updated_us >= {NOW} - 900000000) and not exists (select 1 from v_calls c where c.call_id = s.session_id and c.tombstoned_at is not null) order by updated_us desc, session_id limit 200""",
)
def live_calls(spark, sf_dir):
    gone = view(spark, sf_dir, "v_calls").filter("tombstoned_at is not null").select(F.col("call_id").alias("session_id"))
    return operations.live_calls(view(spark, sf_dir, "v_sessions"), gone, QA, NOW).select("session_id", "agent_id", "team_id", "state", "age_s", "stale")


@query("live_kpi", f"select case when state in ('LIVE', 'DRAINING') and floor(({NOW} - updated_us) / 1000000) > 45 then 'STALE' else state end state, count(*) n from v_sessions where organisation_id = 'org-1' and not purged group by 1")
def live_kpi(spark, sf_dir):
    age = F.floor((F.lit(NOW) - F.col("updated_us")) / 1_000_000)
    s = view(spark, sf_dir, "v_sessions").filter("organisation_id = 'org-1' and not purged")
    return s.groupBy(F.when(F.col("state").isin("LIVE", "DRAINING") & (age > operations.STALE_S), "STALE").otherwise(F.col("state")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("timed_out_sessions", f"select session_id from v_sessions where (state = 'LIVE' and {NOW} - updated_us > 90000000) or (state = 'DRAINING' and {NOW} - updated_us > 7260000000)")
def timed_out_sessions(spark, sf_dir):
    return operations.timed_out(view(spark, sf_dir, "v_sessions"), NOW).select("session_id")


@query("event_feed", "select sequence, call_id, event_type from v_log where organisation_id = 'org-1' and team_id in ('team-0', 'team-3') and sequence > 40 order by sequence limit 100")
def event_feed(spark, sf_dir):
    return operations.feed(view(spark, sf_dir, "v_log"), LEADER, 40).select("sequence", "call_id", "event_type")


@query("feed_cursors", "with t as (select * from (select *, row_number() over (partition by organisation_id order by sequence desc) r from v_log) x where r <= 10000), s as (select organisation_id, max(sequence) hi, min(sequence) lo from t group by 1), c as (select organisation_id, unnest([0::bigint, 50, hi - 5, hi, hi + 1]) as cursor from s) select c.organisation_id, c.cursor, case when c.cursor > hi then 'AHEAD' when c.cursor < lo - 1 then 'EXPIRED' else 'OK' end state from c join s on s.organisation_id = c.organisation_id")
def feed_cursors(spark, sf_dir):
    kept = operations.trimmed(view(spark, sf_dir, "v_log"))
    top = kept.groupBy("organisation_id").agg(F.max("sequence").alias("hi"))
    cursors = top.select("organisation_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(50).cast("long"), F.col("hi") - 5, F.col("hi"), F.col("hi") + 1)).alias("cursor"))
    return operations.cursor_states(cursors, kept)


@query("feed_append", "with a as (select * from v_log where sequence <= 100), m as (select organisation_id, max(sequence) hi from a group by 1) select l.organisation_id, l.call_id, hi + row_number() over (partition by l.organisation_id order by l.us, l.call_id, l.sequence) as sequence from v_log l join m on m.organisation_id = l.organisation_id where l.sequence > 100 and l.event_type = 'purchase'")
def feed_append(spark, sf_dir):
    log = view(spark, sf_dir, "v_log")
    batch = log.filter("sequence > 100 and event_type = 'purchase'").select("organisation_id", "call_id", "us", F.col("sequence").alias("was"))
    return operations.appended(log.filter("sequence <= 100"), batch, "us", "call_id", "was").select("organisation_id", "call_id", "sequence")


@query("frame_gaps", "with d as (select distinct session_id, sequence from v_frames), g as (select *, coalesce(lag(sequence) over (partition by session_id order by sequence), 0) b from d) select session_id, b + 1 first_missing, sequence - 1 last_missing from g where sequence > b + 1")
def frame_gaps(spark, sf_dir):
    return operations.gaps(view(spark, sf_dir, "v_frames"))


@query("frame_offsets", "select session_id, event_id, cast(coalesce(sum(bytes) over (partition by session_id order by us, event_id rows between unbounded preceding and 1 preceding), 0) // 16 as bigint) expected_ms from v_frames")
def frame_offsets(spark, sf_dir):
    return operations.offsets(view(spark, sf_dir, "v_frames"))


@query("idle_sessions", "with a as (select user_id as key, event_id, us, case when us - lag(us) over (partition by user_id order by us, event_id) <= 21600000000 then 0 else 1 end k from v_event_ms), b as (select *, sum(k) over (partition by key order by us, event_id rows between unbounded preceding and current row) s from a) select key, min(us) start_us, max(us) end_us, count(*) n from b group by key, s")
def idle_sessions(spark, sf_dir):
    e = view(spark, sf_dir, "v_event_ms").select(F.col("user_id").alias("key"), "event_id", "us")
    return operations.idle_sessions(e, 21_600_000_000)


_TO = "case event_type when 'click' then 'DRAINING' when 'signup' then 'ENDED' when 'error' then 'INCOMPLETE' else 'NONE' end"


@query(
    "session_states",
    f"""with recursive e as (select user_id session_id, row_number() over (partition by user_id order by us, event_id) i, {_TO} to_state from v_event_ms),
      r as (select session_id, 0::bigint i, 'LIVE' state from (select distinct session_id from e) x
        union all select r.session_id, r.i + 1, case when (r.state = 'LIVE' and e.to_state in ('DRAINING', 'INCOMPLETE')) or (r.state = 'DRAINING' and e.to_state in ('ENDED', 'INCOMPLETE')) then e.to_state else r.state end from r join e on e.session_id = r.session_id and e.i = r.i + 1)
      select session_id, arg_max(state, i) state from r group by 1""",
)
def session_states(spark, sf_dir):
    to = F.when(F.col("event_type") == "click", "DRAINING").when(F.col("event_type") == "signup", "ENDED").when(F.col("event_type") == "error", "INCOMPLETE").otherwise("NONE")
    return operations.replayed(view(spark, sf_dir, "v_event_ms").select(F.col("user_id").alias("session_id"), "us", "event_id", to.alias("to_state")))


@query("first_finals", "with p as (select user_id id, event_id seq, event_type = 'purchase' is_final, event_type || value text from v_event_ms) select id, seq, is_final from (select *, row_number() over (partition by id order by is_final desc, case when is_final then seq end, seq desc) r from p) x where r = 1")
def first_finals(spark, sf_dir):
    p = view(spark, sf_dir, "v_event_ms").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("is_final"), "event_type")
    return operations.first_final(p.withColumnRenamed("event_type", "text")).select("id", "seq", "is_final")


@query("live_utterances", f"select session_id, start_ms, event_id from (select user_id session_id, start_ms, event_id, row_number() over (partition by user_id order by start_ms desc, event_id desc) r from v_event_ms where us + 900000000 > {NOW - 86400000000}) x where r <= 500")
def live_utterances(spark, sf_dir):
    """Rows that have not expired, the newest 500 of each session."""
    rows = view(spark, sf_dir, "v_event_ms").filter(F.col("us") + 900_000_000 > NOW - 86_400_000_000).withColumnRenamed("user_id", "session_id")
    return latest.newest_n(rows, ["session_id"], intake.MAX_LIVE_ROWS, F.desc("start_ms"), F.desc("event_id")).select("session_id", "start_ms", "event_id")


@query("new_live_ids", "select user_id session_id, count(distinct event_id) n_new from v_event_ms e where not exists (select 1 from v_event_ms o where o.event_id = e.event_id and o.event_type in ('view', 'click')) group by 1")
def new_live_ids(spark, sf_dir):
    """All events arrive; views and clicks are there already."""
    e = view(spark, sf_dir, "v_event_ms")
    return operations.new_ids(e.filter("event_type in ('view', 'click')"), e, "event_id", "user_id").withColumnRenamed("user_id", "session_id")


@query("activated_sessions", "with s as (select concat('org-', user_id % 3) organisation_id, user_id call_key, count(*) n, max(us) m from v_event_ms where event_type = 'view' group by 1, 2), x as (select organisation_id, session_id call_key, 5::bigint generation, updated_us from v_sessions where state <> 'LIVE') select coalesce(s.organisation_id, x.organisation_id) organisation_id, coalesce(s.call_key, x.call_key) call_key, coalesce(generation, 0) + coalesce(n, 0) generation, coalesce(m, updated_us) updated_us from x full join s on s.organisation_id = x.organisation_id and s.call_key = x.call_key")
def activated_sessions(spark, sf_dir):
    starts = view(spark, sf_dir, "v_event_ms").filter("event_type = 'view'").select(F.concat(F.lit("org-"), (F.col("user_id") % 3).cast("string")).alias("organisation_id"), F.col("user_id").alias("call_key"), "us")
    there = view(spark, sf_dir, "v_sessions").filter("state <> 'LIVE'").select("organisation_id", F.col("session_id").alias("call_key"), F.lit(5).cast("long").alias("generation"), "updated_us")
    return operations.activated(there, starts)


@query("prepared_segments", "select event_id id, case when event_id % 7 = 0 then 'UNKNOWN' when event_id % 3 = 0 then 'AGENT' when event_id % 3 = 1 then 'CUSTOMER' else 'UNKNOWN' end as role, event_id * 1000 start_ms, (event_id * 1000 + 2500)::bigint end_ms, event_type text, case when value <= 1 then value end confidence from events where event_id % 11 <> 0")
def prepared_segments(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    rows = e.select(i.alias("id"), (i % 3).alias("channel"), (i % 7 != 0).alias("trusted"), i.cast("double").alias("start_s"), (i + 2.5).alias("end_s"), F.when(i % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "event_type")).alias("text"), F.col("value").alias("confidence"))
    return operations.prepared_segments(rows)


@query("segment_faults", "with s as (select case when event_type = 'error' then event_id // 2 else event_id end id, event_id % 9000 start_s, event_id % 9000 + value - 20 end_s from events) select id, 'TIMING' fault from s where start_s > 7200 or end_s > 7200 or end_s < start_s union all select id, 'REPEATED' from s group by id having count(*) > 1")
def segment_faults(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    start = (F.col("event_id") % 9000).cast("double")
    rows = e.select(F.when(F.col("event_type") == "error", F.expr("event_id div 2")).otherwise(F.col("event_id")).alias("id"), start.alias("start_s"), (start + F.col("value") - 20).alias("end_s"), F.col("event_type").alias("text"))
    return operations.segment_faults(rows)


@query("orphan_files", "select c_custkey, 'file-' || c_custkey path from customer c where c_custkey % 10 <> 0 and not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'P')")
def orphan_files(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    old, now = F.to_timestamp(F.lit("2024-01-01 00:00:00")), F.to_timestamp(F.lit("2024-01-03 00:00:00"))
    listing = c.select("c_custkey", F.concat(F.lit("file-"), F.col("c_custkey").cast("string")).alias("path"), F.when(F.col("c_custkey") % 10 == 0, now).otherwise(old).alias("modified"))
    used = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'P'").select(F.concat(F.lit("file-"), F.col("o_custkey").cast("string")).alias("key"))
    return operations.orphans(listing, used, now).select("c_custkey", "path")
