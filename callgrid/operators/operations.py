"""Operational reads and set-at-a-time forms of state changes: jobs, retention, live calls, event feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from callgrid.operators.latest import newest, newest_n
from callgrid.operators.scope import Scope, scoped

# fixed values: seconds of the longest age shown, idle and drain limits, feed and history sizes
MAX_AGE_S, STALE_S, IDLE_S, DRAIN_S, RECENT_S, HISTORY, MAX_BATCH = 31_536_000, 45, 90, 7_260, 900, 10_000, 100
MAX_ATTEMPTS, MAX_CALL_MS = 3, 7_200_000
RANGES = 64


def summary(calls: DataFrame, jobs: DataFrame, as_of_us: int) -> DataFrame:
    """pending_jobs, oldest_age_s (0 to a year) and incomplete_calls of calls that are not tombstoned."""
    seen = calls.filter("tombstoned_at is null")
    waiting = jobs.filter("state in ('QUEUED', 'RETRY_WAIT', 'RUNNING')").join(seen.select("call_id"), "call_id", "left_semi")
    age = F.floor((F.lit(as_of_us) - F.min("available_us")) / 1_000_000)
    a = waiting.agg(F.count(F.lit(1)).alias("pending_jobs"), F.coalesce(F.least(F.lit(MAX_AGE_S).cast("long"), F.greatest(F.lit(0).cast("long"), age)), F.lit(0).cast("long")).alias("oldest_age_s"))
    b = seen.agg(F.count_if(F.col("processing_state") != "READY").alias("incomplete_calls"))
    return a.join(b)  # one row on either side


def due_jobs(jobs: DataFrame, as_of_us: int, limit: int = 1) -> DataFrame:
    """Jobs to claim next: waiting ones whose time has come, and running ones whose lease is over."""
    waiting = F.col("state").isin("QUEUED", "RETRY_WAIT") & (F.col("available_us") <= as_of_us)
    lost = (F.col("state") == "RUNNING") & (F.col("lease_us") < as_of_us)
    return jobs.filter((waiting | lost) & (F.col("attempts") < MAX_ATTEMPTS)).orderBy("available_us", "job_id").limit(limit)


def exhausted(jobs: DataFrame, calls: DataFrame, as_of_us: int) -> DataFrame:
    """Calls that fail because a job has used its attempts and its lease is over."""
    gone = jobs.filter((F.col("state") == "RUNNING") & (F.col("lease_us") < as_of_us) & (F.col("attempts") >= MAX_ATTEMPTS))
    return calls.join(gone.select("call_id").distinct(), "call_id", "left_semi")


def retention_due(calls: DataFrame, as_of: Column, limit: int | None = 100, organisation_id: str | None = None) -> DataFrame:
    """Calls without a hold whose retention ends, of one tenant or all, oldest first."""
    own = calls if organisation_id is None else calls.filter(F.col("organisation_id") == organisation_id)
    rows = own.filter(~F.coalesce("legal_hold", F.lit(False)) & (F.col("retention_expires_at") <= as_of)).orderBy("retention_expires_at", "call_id")
    return rows if limit is None else rows.limit(limit)


def dependants(calls: DataFrame, **children: DataFrame) -> DataFrame:
    """How many rows of each child table belong to the calls: kind, n."""
    keys = calls.select("call_id").distinct()
    out = None
    for kind, df in children.items():
        n = df.join(keys, "call_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def live_calls(sessions: DataFrame, tombstoned: DataFrame, scope: Scope, as_of_us: int, limit: int = 200) -> DataFrame:
    """Sessions that are active or changed lately, newest first, with age and stale. tombstoned: session_id."""
    active = F.col("state").isin("LIVE", "DRAINING")
    rows = scoped(sessions, scope).filter(~F.col("purged")).filter(active | (F.col("updated_us") >= as_of_us - RECENT_S * 1_000_000)).join(tombstoned.select("session_id"), "session_id", "left_anti")
    age = F.floor((F.lit(as_of_us) - F.col("updated_us")) / 1_000_000)
    return rows.withColumn("age_s", age).withColumn("stale", active & (age > STALE_S)).orderBy(F.desc("updated_us"), "session_id").limit(limit)


def timed_out(sessions: DataFrame, as_of_us: int, limit: int | None = None) -> DataFrame:
    """Sessions that become INCOMPLETE: live ones idle too long, and ones that drain too long."""
    idle = as_of_us - F.col("updated_us")
    late = ((F.col("state") == "LIVE") & (idle > IDLE_S * 1_000_000)) | ((F.col("state") == "DRAINING") & (idle > DRAIN_S * 1_000_000))
    rows = sessions.filter(late).withColumn("state", F.lit("INCOMPLETE")).orderBy("updated_us", "session_id")
    return rows if limit is None else rows.limit(limit)


def replayed(events: DataFrame) -> DataFrame:
    """Final state of each session from its events (session_id, us, event_id, to_state); moves that the life
    cycle does not allow change nothing."""
    step = F.struct("us", "event_id", "to_state")
    every = events.select("session_id").distinct()
    # an event that no move leads to changes nothing, so it is not gathered
    events = events.filter(F.col("to_state").isin("DRAINING", "ENDED", "INCOMPLETE"))
    moves = {"LIVE": ("DRAINING", "INCOMPLETE"), "DRAINING": ("ENDED", "INCOMPLETE")}

    def move(state: Column, e: Column) -> Column:
        allowed = F.lit(False)
        for a, to in moves.items():
            allowed = allowed | ((state == a) & e["to_state"].isin(*to))
        return F.when(allowed, e["to_state"]).otherwise(state)

    by = events.groupBy("session_id").agg(F.array_sort(F.collect_list(step)).alias("e"))
    ends = by.select("session_id", F.aggregate("e", F.lit("LIVE"), move).alias("state"))
    return every.join(ends, "session_id", "left").select("session_id", F.coalesce("state", F.lit("LIVE")).alias("state"))


def feed(log: DataFrame, scope: Scope, after: int, limit: int = MAX_BATCH) -> DataFrame:
    """Events of the tenant after a cursor that the role may see, in order."""
    if not 1 <= limit <= MAX_BATCH:
        raise ValueError(f"the limit is 1 to {MAX_BATCH}")
    return scoped(log, scope).filter(F.col("sequence") > after).orderBy("sequence").limit(limit)


def cursor_states(cursors: DataFrame, log: DataFrame) -> DataFrame:
    """cursors: organisation_id, cursor. Adds AHEAD, EXPIRED (the log's history no longer reaches back) or OK."""
    span = log.groupBy("organisation_id").agg(F.max("sequence").alias("last"), F.min("sequence").alias("oldest"))
    return cursors.join(span, "organisation_id", "left").select("organisation_id", "cursor", F.when(F.col("cursor") > F.coalesce("last", F.lit(0)), "AHEAD").when(F.col("cursor") < F.col("oldest") - 1, "EXPIRED").otherwise("OK").alias("state"))


def trimmed(log: DataFrame, keep: int = HISTORY) -> DataFrame:
    """The newest events of each tenant."""
    return newest_n(log, ["organisation_id"], keep, F.desc("sequence"))


def appended(log: DataFrame, batch: DataFrame, *order: str) -> DataFrame:
    """A batch with the sequence numbers that follow each tenant's last. The first order column is a number."""
    last = log.groupBy("organisation_id").agg(F.max("sequence").alias("_last"))
    # a tenant's events lie in ranges of the first order column, between quantiles of the batch; a row's
    # number is its place in its range and the number of rows in the ranges before
    at = F.col(order[0]).cast("double")
    bounds = batch.agg(F.percentile_approx(at, F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])).alias("_bounds"))
    dealt = batch.join(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b <= at))).drop("_bounds")  # one row
    sizes = dealt.groupBy("organisation_id", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("organisation_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("organisation_id", "_range").orderBy(*order))).join(sizes.select("organisation_id", "_range", before.alias("_before")), ["organisation_id", "_range"])
    return placed.join(last, "organisation_id", "left").withColumn("sequence", (F.coalesce("_last", F.lit(0)) + F.col("_before") + F.col("_at")).cast("long")).drop("_last", "_before", "_at", "_range")


def gaps(frames: DataFrame) -> DataFrame:
    """Missing sequence ranges of each session: session_id, first_missing, last_missing."""
    w = Window.partitionBy("session_id").orderBy("sequence")
    rows = frames.select("session_id", "sequence").distinct().withColumn("before", F.coalesce(F.lag("sequence").over(w), F.lit(0)))
    return rows.filter(F.col("sequence") > F.col("before") + 1).select("session_id", (F.col("before") + 1).alias("first_missing"), (F.col("sequence") - 1).alias("last_missing"))


def offsets(frames: DataFrame, bytes_per_ms: int = 16) -> DataFrame:
    """Where each frame must start, from the bytes before it: session_id, event_id, expected_ms."""
    w = Window.partitionBy("session_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("bytes").over(w), F.lit(0)).alias("b")
    return frames.select("session_id", "event_id", before).select("session_id", "event_id", F.expr(f"b div {bytes_per_ms}").alias("expected_ms"))


def idle_sessions(events: DataFrame, gap_us: int) -> DataFrame:
    """Activity of a key between idle gaps: key, start_us, end_us, n."""
    w = Window.partitionBy("key").orderBy("us", "event_id")
    new = F.when(F.col("us") - F.lag("us").over(w) <= gap_us, 0).otherwise(1)
    rows = events.withColumn("_new", new).withColumn("_s", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("key", "_s").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n")).drop("_s")


def inserted(existing: DataFrame, batch: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Each row of a batch as NEW, SAME (key there with equal payload) or CONFLICT; for an insert that can be
    repeated, the NEW rows are written."""
    there = existing.select(*keys, F.col(payload).alias("_there"))
    rows = batch.join(there, keys, "left")
    return rows.withColumn("outcome", F.when(F.col("_there").isNull(), "NEW").when(F.col("_there").eqNullSafe(F.col(payload)), "SAME").otherwise("CONFLICT")).drop("_there")


def new_ids(existing: DataFrame, batch: DataFrame, id_col: str, by: str) -> DataFrame:
    """How many identifiers of a batch are not there yet, by a column of the batch: n_new."""
    return batch.join(existing.select(id_col), id_col, "left_anti").groupBy(by).agg(F.countDistinct(id_col).alias("n_new"))


def upserted(existing: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The table after a batch: rows of the batch win over those present."""
    both = existing.withColumn("_from", F.lit(0)).unionByName(batch.withColumn("_from", F.lit(1)))
    return newest(both, keys, F.desc("_from")).drop("_from")


def first_final(parts: DataFrame) -> DataFrame:
    """parts: id, seq, is_final, text. The first final text of an id, else its last partial one."""
    w = Window.partitionBy("id").orderBy(F.desc("is_final"), F.when(F.col("is_final"), F.col("seq")), F.desc("seq"))
    return parts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("id", "seq", "is_final", "text")


def version_status(versions: DataFrame, active: DataFrame, events: DataFrame) -> DataFrame:
    """ACTIVE, RETIRED (was active), APPROVED (by someone other than its author) or STAGED, with the first such
    approver. active: config_id, version."""
    key = ["config_id", "version"]
    was = events.filter("action = 'ACTIVATED'").select(*key).distinct().withColumn("_was", F.lit(True))
    others = events.filter("action = 'APPROVED'").select(*key, F.col("actor").alias("by"), "at_").join(versions.select(*key, "actor"), key).filter("by <> actor")
    approved = others.groupBy(*key).agg(F.min_by("by", "at_").alias("approved_by"))
    rows = versions.join(active.select(*key).distinct().withColumn("_active", F.lit(True)), key, "left").join(was, key, "left").join(approved, key, "left")
    status = F.when(F.col("_active"), "ACTIVE").when(F.col("_was"), "RETIRED").when(F.col("approved_by").isNotNull(), "APPROVED").otherwise("STAGED")
    return rows.select(*key, status.alias("status"), "approved_by")


def segment_faults(segments: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Segments with text that no transcript may hold: their keys (such as call and id) and fault, TIMING (seconds
    that are null or not finite, before 0, turned, or beyond the longest call) or REPEATED (keys there twice)."""
    spoken = segments.filter(F.length(F.trim("text")) > 0)
    end = F.lit(MAX_CALL_MS / 1000)
    fine = F.col("start_s").between(0, end) & F.col("end_s").between(F.col("start_s"), end)  # a NaN is larger than any number
    wrong = spoken.filter(~F.coalesce(fine, F.lit(False))).select(*keys, F.lit("TIMING").alias("fault"))
    twice = spoken.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys, F.lit("REPEATED").alias("fault"))
    return wrong.unionByName(twice)


def prepared_segments(segments: DataFrame, strict: bool = False) -> DataFrame:
    """Segments of a recogniser as utterances: blank text dropped, seconds to milliseconds (halves to even),
    channel to role where the mapping is trusted, confidence outside 0 to 1 to null. With `strict`, a segment
    that ``segment_faults`` names is an error."""
    if strict:
        bad = F.assert_true(F.col("fault").isNull(), F.concat(F.lit("segment "), F.col("id").cast("string"), F.lit(": "), F.col("fault")))
        faults = segment_faults(segments).groupBy("id").agg(F.min("fault").alias("fault"))
        segments = segments.join(faults, "id", "left").withColumn("_fine", bad).filter("_fine is null").drop("_fine", "fault")
    fine = F.col("confidence").between(0, 1) & ~F.isnan("confidence")
    role = F.when(~F.coalesce("trusted", F.lit(False)), "UNKNOWN").when(F.col("channel") == 0, "AGENT").when(F.col("channel") == 1, "CUSTOMER").otherwise("UNKNOWN")
    return segments.filter(F.length(F.trim("text")) > 0).select("id", role.alias("role"), F.bround(F.col("start_s") * 1000).cast("long").alias("start_ms"), F.bround(F.col("end_s") * 1000).cast("long").alias("end_ms"), F.trim("text").alias("text"), F.when(fine, F.col("confidence")).alias("confidence"))


def activated(existing: DataFrame, starts: DataFrame) -> DataFrame:
    """Sessions after start events (organisation_id, call_key, us): each start is one more generation."""
    n = starts.groupBy("organisation_id", "call_key").agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("started_us"))
    rows = existing.join(n, ["organisation_id", "call_key"], "full")
    return rows.select("organisation_id", "call_key", (F.coalesce("generation", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("generation"), F.coalesce("started_us", "updated_us").alias("updated_us"))


def orphans(listing: DataFrame, referenced: DataFrame, as_of: Column, least_age_days: int = 1) -> DataFrame:
    """Files (path, modified) that no row refers to (key = path) and that are old enough. Nothing is deleted."""
    old = listing.filter(F.col("modified") < as_of - F.make_dt_interval(F.lit(least_age_days)))
    return old.join(referenced.select(F.col("key").alias("path")).distinct(), "path", "left_anti")
