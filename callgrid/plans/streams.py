"""Queries that run a stream over a table to its end: session life cycles, media sessions, the event feed."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from callgrid.operators import operations
from callgrid.plans.catalog import query
from callgrid.sources.derived import view
from callgrid.streaming import feed, media, sessions
from callgrid.streaming.run import drained, streamed

# limits of the queries, in seconds: the test tables' events lie hours apart
IDLE, DRAIN = 86_400, 172_800
_MOVES = {"view": "START", "click": "DRAINING", "signup": "ENDED", "error": "INCOMPLETE", "purchase": "ACTIVITY"}
_ACTIVE = f"(state = 'LIVE' and us > since + {IDLE * 1_000_000}) or (state = 'DRAINING' and us > since + {DRAIN * 1_000_000})"


@query(
    "session_stream",
    f"""with recursive e as (select user_id session_id, row_number() over (partition by user_id order by us, event_id) i, us, event_type, case when event_id % 5 = 0 then 1 end g from v_event_ms),
      r as (select session_id, 0::bigint i, null::varchar state, 0::bigint gen, 0::bigint since, 0::bigint n_applied, 0::bigint n_timed_out from (select distinct session_id from e) x
        union all
        select session_id, i, case when ok then case event_type when 'view' then 'LIVE' when 'purchase' then 'LIVE' when 'click' then 'DRAINING' when 'signup' then 'ENDED' else 'INCOMPLETE' end else state end, gen + (event_type = 'view')::int, case when ok then us else since end, n_applied + ok::int, n_timed_out + late::int
        from (select *, case when event_type = 'view' then true when state is null or (g is not null and g <> gen) then false when event_type in ('purchase', 'click') then state = 'LIVE' when event_type = 'signup' then state = 'DRAINING' else state in ('LIVE', 'DRAINING') end ok
          from (select session_id, i, us, event_type, g, gen, since, n_applied, n_timed_out, late, case when late then 'INCOMPLETE' else state end state
            from (select r.session_id, e.i, e.us, e.event_type, e.g, r.state, r.gen, r.since, r.n_applied, r.n_timed_out, coalesce({_ACTIVE}, false) late from r join e on e.session_id = r.session_id and e.i = r.i + 1) a) b) c),
      f as (select session_id, arg_max(coalesce(state, ''), i) state, arg_max(gen, i) generation, arg_max(since, i) since, max(n_applied) n_applied, max(n_timed_out) n_timed_out from r group by 1),
      z as (select *, coalesce((case state when 'LIVE' then (since + {IDLE * 1_000_000}) // 1000 when 'DRAINING' then (since + {DRAIN * 1_000_000}) // 1000 end) + 1 <= (select max(us) // 1000 from e), false) late from f)
      select session_id, case when late then 'INCOMPLETE' when state = '' then null else state end state, generation, n_applied, n_timed_out + late::int n_timed_out from z""",
)
def session_stream(spark, sf_dir):
    """Events as they come: views start a generation, the other kinds move it on; times run out meanwhile."""
    events = streamed(spark.read.parquet(f"{sf_dir}/events.parquet"))
    move = F.create_map(*[F.lit(x) for pair in _MOVES.items() for x in pair])[F.col("event_type")]
    rows = events.select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", move.alias("move"), F.when(F.col("event_id") % 5 == 0, 1).alias("generation"))
    out = drained(sessions.lifecycle(rows, sessions.Limits(IDLE, DRAIN, None), "0 seconds"))
    order = F.struct("us", F.col("event_id").isNull(), "event_id")
    ends = out.groupBy("session_id").agg(F.max_by(F.struct("state", "generation"), order).alias("end"), F.count_if(F.col("outcome") == "APPLIED").alias("n_applied"), F.count_if(F.col("outcome") == "TIMED_OUT").alias("n_timed_out"))
    return ends.select("session_id", "end.state", F.coalesce("end.generation", F.lit(0)).alias("generation"), "n_applied", "n_timed_out")


@query(
    "media_session_gaps",
    """with d as (select distinct user_id call_id, 2 + (us - 1704067200000000) // 60000000 as sequence from v_event_ms), g as (select *, coalesce(lag(sequence) over (partition by call_id order by sequence), 1) b from d)
      select call_id, b + 1 first_missing, sequence - 1 last_missing from g where sequence > b + 1""",
)
def media_session_gaps(spark, sf_dir):
    """Raw lines of each user's session (a frame an event, numbered by the minute) to the numbers missing
    before each line that counts."""
    along = Window.partitionBy("user_id").orderBy("us", "event_id")
    frames = view(spark, sf_dir, "v_event_ms").withColumns({"n": F.row_number().over(along), "sequence": F.expr("2 + (us - 1704067200000000) div 60000000")})
    call = F.col("user_id").cast("string")
    sound = F.to_json(F.struct(F.lit("media").alias("event"), F.col("sequence").alias("sequence_number"), call.alias("stream_sid"), F.struct(F.col("n").alias("chunk"), F.col("n").cast("string").alias("timestamp"), F.translate(F.base64(F.encode(F.repeat(F.lit("ab"), (F.col("event_id") % 200 + 1).cast("int")), "UTF-8")), "\r\n", "").alias("payload")).alias("media")))
    form = F.struct(F.lit("raw").alias("encoding"), F.lit(8000).alias("sample_rate"))
    begin = F.to_json(F.struct(F.lit("start").alias("event"), F.lit(1).alias("sequence_number"), call.alias("stream_sid"), F.struct(call.alias("stream_sid"), call.alias("call_sid"), F.lit("acct").alias("account_sid"), form.alias("media_format")).alias("start")))
    heads = frames.groupBy("user_id").agg(F.min("us").alias("us")).select("user_id", "us", F.explode(F.array(F.struct(F.lit(-1).alias("arrival"), F.lit('{"event":"connected"}').alias("value")), F.struct(F.lit(0).alias("arrival"), begin.alias("value")))).alias("x")).select("user_id", "us", F.col("x.arrival").cast("long").alias("arrival"), "x.value")
    lines = frames.select("user_id", "us", F.col("n").cast("long").alias("arrival"), sound.alias("value")).unionByName(heads)
    lines = lines.select(F.lit("acct").alias("account_id"), F.col("user_id").cast("string").alias("call_id"), F.lit(1).cast("long").alias("generation"), F.timestamp_micros("us").alias("ts"), "arrival", "value")
    out = drained(media.media_sessions(streamed(lines), idle_s=None))
    return out.filter("first_missing is not null").select(F.col("call_id").cast("long").alias("call_id"), "first_missing", "last_missing")


@query("feed_stream", f"select organisation_id, sequence, call_id, event_type from (select *, max(sequence) over (partition by organisation_id) hi from v_log) x where sequence > hi - {operations.HISTORY}")
def feed_stream(spark, sf_dir):
    """The event table through the feed's sink."""
    events = streamed(spark.read.parquet(f"{sf_dir}/events.parquet"))
    user = F.col("user_id")
    rows = events.select(F.concat(F.lit("org-"), (user % 3).cast("string")).alias("organisation_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", user.alias("call_id"), F.concat(F.lit("agent-"), (user % 10).cast("string")).alias("agent_id"), F.concat(F.lit("team-"), (user % 4).cast("string")).alias("team_id"), "event_type")
    kind = rows.schema
    sink = feed.Feed(spark, feed.new_path(spark), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind.fields[1:]))
    return feed.fed(rows, sink, "us", "event_id").events().select("organisation_id", "sequence", "call_id", "event_type")
