"""Queries over utterances, intervals, sentiment and dispositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from callgrid.operators import audit, disposition, intervals, policy, sentiment
from callgrid.plans.catalog import ORACLES, query
from callgrid.sources.derived import view

_MERGED = """m0 as (select *, max(end_ms) over (partition by call_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) reach from v_intervals),
  m1 as (select *, sum(case when start_ms <= reach then 0 else 1 end) over (partition by call_id order by start_ms, end_ms rows between unbounded preceding and current row) k from m0),
  merged as (select call_id, min(start_ms) start_ms, max(end_ms) end_ms from m1 group by call_id, k)"""


@query("interval_merge", f"with {_MERGED} select * from merged")
def interval_merge(spark, sf_dir):
    return intervals.merge_intervals(view(spark, sf_dir, "v_intervals").select("call_id", "start_ms", "end_ms"))


@query("hold_overlap", f"with {_MERGED} select call_id, sum(greatest(0, least(200000, end_ms) - greatest(100000, start_ms)))::bigint held_ms from merged group by 1")
def hold_overlap(spark, sf_dir):
    by = view(spark, sf_dir, "v_intervals").groupBy("call_id").agg(F.collect_list(F.struct("start_ms", "end_ms")).alias("h"))
    return by.select("call_id", intervals.overlap(intervals.merged_array(F.col("h")), F.lit(100000), F.lit(200000)).alias("held_ms"))


@query(
    "hold_deadline",
    f"""with recursive {_MERGED}, o as (select *, row_number() over (partition by call_id order by start_ms) i from merged),
      w as (select call_id, 0::bigint i, (call_id * 100 + 30000)::bigint at_ from (select distinct call_id from o) x
        union all select w.call_id, w.i + 1, case when o.start_ms < w.at_ then case when o.end_ms > w.call_id * 100 then w.at_ + o.end_ms - greatest(o.start_ms, w.call_id * 100) else w.at_ end else w.at_ end from w join o on o.call_id = w.call_id and o.i = w.i + 1)
      select call_id, max(at_) deadline_ms from w group by 1""",
)
def hold_deadline(spark, sf_dir):
    by = view(spark, sf_dir, "v_intervals").groupBy("call_id").agg(F.collect_list(F.struct("start_ms", "end_ms")).alias("h"))
    return by.select("call_id", intervals.paused_deadline(F.col("call_id") * 100, F.lit(30000), intervals.merged_array(F.col("h"))).alias("deadline_ms"))


ORACLES["long_call_holds"] = ORACLES["hold_deadline"]


@query("long_call_holds")
def long_call_holds(spark, sf_dir):
    """hold_deadline by scans over ranges, without an array of a call's holds."""
    holds = view(spark, sf_dir, "v_intervals").select("call_id", "start_ms", "end_ms")
    starts = holds.select("call_id").distinct().select("call_id", (F.col("call_id") * 100).alias("start_ms"), F.lit(30000).cast("long").alias("opportunity_ms"))
    return intervals.long_deadlines(starts, holds)


@query("spoken_holds", "select u.call_id, u.turn, count(*) n_holds, sum(least(u.end_ms, i.end_ms) - greatest(u.start_ms, i.start_ms))::bigint held_ms from v_utterances u join v_intervals i on i.call_id = u.call_id and i.start_ms < u.end_ms and u.start_ms < i.end_ms and i.start_ms < i.end_ms group by 1, 2")
def spoken_holds(spark, sf_dir):
    """Utterances and the holds that they overlap, by a join on bins."""
    u = view(spark, sf_dir, "v_utterances").select("call_id", "turn", "start_ms", "end_ms")
    pairs = intervals.overlapping(u, view(spark, sf_dir, "v_intervals").select("call_id", "start_ms", "end_ms"))
    return pairs.groupBy("call_id", "turn").agg(F.count(F.lit(1)).alias("n_holds"), F.sum("overlap_ms").alias("held_ms"))


# phrases of the invented prose of the test tables
OPENING = {"opportunity_ms": 30_000, "phrase_variants": ["the of", "de la", "die der", "of the"]}
CLOSING = {"window_ms": 15_000, "phrase_variants": ["the the", "de la", "in the"]}

_ELIGIBLE = """u as (select x.*, c.duration_ms, c.connected_ms, c.complete, c.timing_reliable, c.connected_ms <= c.duration_ms and c.complete and c.timing_reliable and c.hold_end <= c.duration_ms reliable,
    case when c.hold_end <= c.duration_ms then c.hold_start end h0, case when c.hold_end <= c.duration_ms then c.hold_end end h1 from v_utterances x join v_contexts c on c.call_id = x.call_id),
  n as (select *, trim(regexp_replace(regexp_replace(lower(text), '[^\\w\\s\\x{{00c0}}-\\x{{024f}}]', ' ', 'g'), '\\s+', ' ', 'g')) t from u)"""


def _contexts(spark, sf_dir):
    hold = F.struct(F.lit("HOLD").alias("tag"), F.col("hold_start").alias("start_ms"), F.col("hold_end").alias("end_ms"))
    return view(spark, sf_dir, "v_contexts").withColumn("holds", F.array(hold))


def _spoken(spark, sf_dir):
    return view(spark, sf_dir, "v_utterances").withColumn("is_final", F.lit(True)).withColumnRenamed("turn", "id")


def _phrase(phrases: list[str]) -> str:
    return "(" + " or ".join(f"contains(t, '{p}')" for p in phrases) + ")"


# no two agent utterances of the test tables are neighbours, so a run is one utterance
@query(
    "opening_disclosure",
    f"""with {_ELIGIBLE.format()}, d as (select *, case when h0 < connected_ms + 30000 and h1 > connected_ms then connected_ms + 30000 + h1 - greatest(h0, connected_ms) else connected_ms + 30000 end deadline from n),
      e as (select *, least(duration_ms, deadline) w1 from d), f as (select *, connected_ms <= start_ms and start_ms <= end_ms and end_ms <= w1 and coalesce(least(end_ms, h1) - greatest(start_ms, h0), 0) <= 0 ok from e),
      g as (select call_id, bool_or(coalesce(ok and role = 'AGENT' and {_phrase(OPENING['phrase_variants'])}, false)) hit, min(case when ok and role = 'AGENT' and {_phrase(OPENING['phrase_variants'])} then turn end) at_, any_value(reliable) reliable, any_value(complete) complete, any_value(deadline) deadline_ms,
        any_value(greatest(0, w1 - connected_ms - greatest(0, coalesce(least(w1, h1) - greatest(connected_ms, h0), 0)))) elapsed from f group by call_id),
      s as (select *, case when not reliable then 'UNKNOWN' when hit then 'SATISFIED' when elapsed >= 30000 then 'POTENTIAL_VIOLATION' when complete then 'UNKNOWN' else 'PENDING' end status from g)
      select call_id, status, case when status = 'SATISFIED' then cast(at_ as varchar) else '' end evidence, case when status = 'SATISFIED' then sha256('["' || at_ || '"]') else sha256('[]') end evidence_fingerprint, deadline_ms from s""",
)
def opening_disclosure(spark, sf_dir):
    rows = policy.opening_disclosure(_spoken(spark, sf_dir), _contexts(spark, sf_dir), OPENING)
    return rows.select("call_id", "status", F.array_join("evidence_ids", ",").alias("evidence"), "evidence_fingerprint", "deadline_ms")


@query(
    "closing_phrase",
    f"""with {_ELIGIBLE.format()}, e as (select *, greatest(0, duration_ms - 15000) w0 from n), f as (select *, w0 <= start_ms and start_ms <= end_ms and end_ms <= duration_ms and coalesce(least(end_ms, h1) - greatest(start_ms, h0), 0) <= 0 ok from e),
      g as (select call_id, bool_or(coalesce(ok and role = 'AGENT' and {_phrase(CLOSING['phrase_variants'])}, false)) hit, min(case when ok and role = 'AGENT' and {_phrase(CLOSING['phrase_variants'])} then turn end) at_, any_value(reliable) reliable, any_value(w0) deadline_ms from f group by call_id),
      s as (select *, case when not reliable then 'UNKNOWN' when hit then 'SATISFIED' else 'POTENTIAL_VIOLATION' end status from g)
      select call_id, status, case when status = 'SATISFIED' then cast(at_ as varchar) else '' end evidence, case when status = 'SATISFIED' then sha256('["' || at_ || '"]') else sha256('[]') end evidence_fingerprint, deadline_ms from s""",
)
def closing_phrase(spark, sf_dir):
    rows = policy.closing_phrase(_spoken(spark, sf_dir), _contexts(spark, sf_dir), CLOSING)
    return rows.select("call_id", "status", F.array_join("evidence_ids", ",").alias("evidence"), "evidence_fingerprint", "deadline_ms")


RULESET = {
    "schema_version": "1",
    "ruleset_id": "prose",
    "version": 3,
    "policy_text_version": "p1",
    "rules": [
        {"id": "opening", "type": "OPENING_DISCLOSURE", "call_types": ["*"], "severity": "HIGH", "remediation": "say so", **OPENING},
        {"id": "closing", "type": "CLOSING_PHRASE", "call_types": ["*"], "severity": "LOW", "remediation": "say goodbye", **CLOSING},
        {"id": "numbers", "type": "SENSITIVE_NUMBER_ADVISORY", "call_types": ["*"], "severity": "LOW", "remediation": "none"},
    ],
}


@query("policy_findings")
def policy_findings(spark, sf_dir):
    """The findings of a whole rule set: those of its rules, one query each, with what the rule says."""
    compiled = policy.compile_ruleset(RULESET)
    return policy.findings(_spoken(spark, sf_dir), _contexts(spark, sf_dir), compiled).select("rule_id", "severity", "ruleset_version", "call_id", "status", "evidence_fingerprint", "deadline_ms")


_RULE = "select '{0}' rule_id, '{1}' severity, 'prose:3' ruleset_version, call_id, status, evidence_fingerprint, deadline_ms from ({2}) x"
ORACLES["policy_findings"] = _RULE.format("opening", "HIGH", ORACLES["opening_disclosure"]) + " union all " + _RULE.format("closing", "LOW", ORACLES["closing_phrase"])


@query("evidence_quotes", "select call_id, turn utterance_id, role = 'AGENT' and length(trim(substr(text, 3, 20))) > 0 valid from v_utterances")
def evidence_quotes(spark, sf_dir):
    u = _spoken(spark, sf_dir)
    quotes = u.select("call_id", F.col("id").alias("utterance_id"), F.substring("text", 3, 20).alias("quote"))
    return audit.checked_quotes(quotes, u).select("call_id", "utterance_id", "valid")


@query("missing_evidence", "select call_id, cast(t as varchar) id from (select call_id, max(turn) + 1 t from v_utterances group by 1 union all select call_id, 0 from v_utterances where turn = 1) x where not exists (select 1 from v_utterances u where u.call_id = x.call_id and u.turn = x.t)")
def missing_evidence(spark, sf_dir):
    u = _spoken(spark, sf_dir)
    refs = u.groupBy("call_id").agg(F.array(F.lit("0"), (F.max("id") + 1).cast("string")).alias("evidence_ids"))
    return policy.missing_evidence(refs, u)


_WINDOWS = """w as (select call_id, start_ms // 30000 w, count(*) n, sum(score_c) s, sum(prob_c) p from v_signals group by 1, 2),
  drops as (select a.call_id, (a.w + 1) * 30000 alert_ms from w a join w b on b.call_id = a.call_id and b.w = a.w - 1 where a.n >= 3 and b.n >= 3 and b.s * a.n - a.s * b.n >= 40 * a.n * b.n and a.p + b.p >= 70 * (a.n + b.n))"""


def _signals(spark, sf_dir):
    hundredth = lambda c: (F.col(c).cast("decimal(5,0)") * F.lit("0.01").cast("decimal(2,2)")).alias(c[:-2])
    return view(spark, sf_dir, "v_signals").select("call_id", "signal_id", "start_ms", "dur", hundredth("score_c"), hundredth("prob_c"))


@query("sentiment_drops", f"with {_WINDOWS} select * from drops")
def sentiment_drops(spark, sf_dir):
    return sentiment.drop_windows(_signals(spark, sf_dir))


@query("sentiment_alerts", f"with recursive {_WINDOWS}, keep as (select call_id, min(alert_ms) alert_ms from drops group by 1 union all select k.call_id, (select min(d.alert_ms) from drops d where d.call_id = k.call_id and d.alert_ms >= k.alert_ms + 90000) from keep k where k.alert_ms is not null) select * from keep where alert_ms is not null")
def sentiment_alerts(spark, sf_dir):
    return sentiment.alerts(_signals(spark, sf_dir))


ORACLES["long_call_alerts"] = ORACLES["sentiment_alerts"]


@query("long_call_alerts")
def long_call_alerts(spark, sf_dir):
    """sentiment_alerts by doubling pointers, without an array of a call's alerts."""
    return sentiment.long_alerts(_signals(spark, sf_dir))


@query(
    "speech_trend",
    """with o as (select *, coalesce(sum(dur) over (partition by call_id order by start_ms, signal_id rows between unbounded preceding and 1 preceding), 0) b1, coalesce(sum(dur) over (partition by call_id order by start_ms desc, signal_id desc rows between unbounded preceding and 1 preceding), 0) b2 from v_signals)
      select call_id, sum(dur) filter (where b1 < 60000)::bigint first_ms, round(sum(score_c * dur) filter (where b1 < 60000) / sum(dur) filter (where b1 < 60000) / 100, 6) first_mean, sum(dur) filter (where b2 < 60000)::bigint last_ms, round(sum(score_c * dur) filter (where b2 < 60000) / sum(dur) filter (where b2 < 60000) / 100, 6) last_mean from o group by 1""",
)
def speech_trend(spark, sf_dir):
    return sentiment.speech_trend(_signals(spark, sf_dir)).select("call_id", "first_ms", F.round("first_mean", 6).alias("first_mean"), "last_ms", F.round("last_mean", 6).alias("last_mean"))


@query("signed_scores", "select signal_id, round(greatest(-1, least(1, (prob_c - (100 - prob_c) * 0.5) / 100)), 6) score, round(greatest(prob_c / 100, (100 - prob_c) * 0.5 / 100), 6) prob from v_signals")
def signed_scores(spark, sf_dir):
    p = F.col("prob_c") / 100
    classes = F.create_map(F.lit("positive"), p, F.lit("negative"), (1 - p) / 2, F.lit("neutral"), (1 - p) / 2)
    s = view(spark, sf_dir, "v_signals").withColumn("s", sentiment.signed_score(classes))
    return s.select("signal_id", F.round("s.score", 6).alias("score"), F.round("s.prob", 6).alias("prob"))


@query("call_sentiment", "with c as (select call_id, count(*) n, count(*) filter (where length(text) % 5 <> 0) k from v_utterances where role = 'CUSTOMER' group by 1) select a.call_id, coalesce(k, 0) scored, case when n is null then 'UNAVAILABLE' when k < n then 'UNKNOWN' else 'OK' end status from (select distinct call_id from v_utterances) a left join c on c.call_id = a.call_id")
def call_sentiment(spark, sf_dir):
    u = _spoken(spark, sf_dir)
    return sentiment.call_sentiment(u, u.filter(F.length("text") % 5 != 0).select("call_id", "id", F.lit(0.5).alias("score")))


@query("chunk_signals", "select call_id, max(p100) - min(p100) > 25 conflict, case when max(p100) - min(p100) <= 25 then round(avg(p100) / 100, 6) end as value, case when max(p100) - min(p100) <= 25 then min(conf100) / 100 end confidence from v_chunks group by 1")
def chunk_signals(spark, sf_dir):
    # hundredths as decimals: the spread of exactly 0.25 is no conflict
    exact = lambda c: F.col(c).cast("decimal(5,0)") * F.lit("0.01").cast("decimal(2,2)")
    rows = view(spark, sf_dir, "v_chunks").select("call_id", exact("p100").alias("value"), exact("conf100").alias("confidence"))
    out = disposition.aggregate_chunks(rows, "noul")
    return out.select("call_id", "conflict", F.round(F.col("value").cast("double"), 6).alias("value"), F.col("confidence").cast("double").alias("confidence"))


@query(
    "chunk_choices",
    """with c as (select *, 100 - a100 - b100 c100, case when a100 >= b100 and a100 >= 100 - a100 - b100 then 'A' when b100 >= 100 - a100 - b100 then 'B' else 'C' end as value from v_choices),
      s as (select call_id, count(distinct case when conf100 >= 45 then value end) > 1 conflict, avg(a100) a, avg(b100) b, avg(c100) c, min(conf100) / 100 k from c group by 1)
      select call_id, conflict, case when conflict then null when a >= b and a >= c then 'A' when b >= c then 'B' else 'C' end as value, case when not conflict then round(greatest(a, b, c) / 100, 6) end probability, case when not conflict then k end confidence from s""",
)
def chunk_choices(spark, sf_dir):
    exact = lambda c: c.cast("decimal(5,0)") * F.lit("0.01").cast("decimal(2,2)")
    rest = 100 - F.col("a100") - F.col("b100")
    value = F.when((F.col("a100") >= F.col("b100")) & (F.col("a100") >= rest), "A").when(F.col("b100") >= rest, "B").otherwise("C")
    rows = view(spark, sf_dir, "v_choices").select("call_id", value.alias("value"), F.create_map(F.lit("A"), exact(F.col("a100")), F.lit("B"), exact(F.col("b100")), F.lit("C"), exact(rest)).alias("probabilities"), exact(F.col("conf100")).alias("confidence"))
    out = disposition.aggregate_chunks(rows, "choice")
    return out.select("call_id", "conflict", "value", F.round(F.col("probability").cast("double"), 6).alias("probability"), F.col("confidence").cast("double").alias("confidence"))


@query("choice_validation", "with c as (select call_id, chunk, a100, b100, 100 - a100 - b100 c100, conf100 from v_choices) select call_id, chunk, a100 + 2 >= greatest(a100, b100, c100) and abs(a100 - conf100) <= 2 valid from c")
def choice_validation(spark, sf_dir):
    hundredth = lambda c: c.cast("decimal(5,0)") * F.lit("0.01").cast("decimal(2,2)")
    rows = view(spark, sf_dir, "v_choices")
    p = F.create_map(F.lit("A"), hundredth(F.col("a100")), F.lit("B"), hundredth(F.col("b100")), F.lit("C"), hundredth(100 - F.col("a100") - F.col("b100")))
    fits = lambda limit: disposition.choice_valid(F.lit("A"), p, hundredth(F.col("conf100")))
    return rows.select("call_id", "chunk", fits(0.02).alias("valid"))


CONFIG = {
    "config_id": "calls-en",
    "version": 1,
    "identity": {"use_case_id": "service-calls"},
    "questions": {"commitment": {"type": "noul"}, "mood": {"type": "score"}},
    "taxonomy": {"codes": [{"code": c, "level": 0, "parent_code": None} for c in ("NO_CONTACT", "COMMITTED", "UPSET", "NEUTRAL", "REVIEW")]},
    "front_gates": [{"id": "NO_CONNECTION", "priority": 10, "source": "line", "condition": {"operator": "IN", "value": ["NO_ANSWER", "FAILED"]}, "emit": "NO_CONTACT"}],
    "resolver": {
        "default_emit": "NEUTRAL",
        "rules": [
            {"id": "UPSET_CALL", "priority": 200, "when": {"any": [{"signal": "mood", "operator": "SCORE_LTE", "value": 0.2}, {"all": [{"signal": "mood", "operator": "EXISTS"}]}]}, "emit": "UPSET"},
            {"id": "COMMITMENT", "priority": 100, "when": {"all": [{"signal": "commitment", "operator": "NOUL_GTE", "value": 0.75}, {"not": {"signal": "mood", "operator": "SCORE_LTE", "value": 0.1}}]}, "emit": "COMMITTED"},
            {"id": "KEEN", "priority": 50, "when": {"all": [{"signal": "commitment", "operator": "NOUL_GTE", "value": 0.9}, {"signal": "mood", "operator": "SCORE_GTE", "value": 0.5}]}, "emit": "COMMITTED"},
        ],
    },
    "confidence": {"default_commit_threshold": 0.65, "default_review_threshold": 0.45, "per_code": {"COMMITTED": {"commit_threshold": 0.7}}},
}


@query(
    "dispositions",
    """with s as (select event_id, case when event_id % 17 = 0 then 'FAILED' when event_id % 5 = 0 then 'OK' end line, case when event_id % 23 <> 0 then (event_id * 7 % 101) / 100.0 end p, (event_id * 13 % 101) / 100.0 m, (50 + event_id * 11 % 50) / 100.0 c1, (50 + event_id * 19 % 50) / 100.0 c2 from events),
      r as (select *, case when p >= 0.9 and m >= 0.5 then 'KEEN' when m <= 0.2 then 'UPSET_CALL' end rule, least(c1, c2) lowest from s),
      t as (select *, case when rule = 'KEEN' then lowest when rule = 'UPSET_CALL' then c2 end conf, case when rule = 'KEEN' then 0.7 else 0.65 end need, line = 'FAILED' is true gated from r),
      z as (select *, case when gated then null when p is null then 'MISSING_OR_EXTRA_SIGNAL' when rule is null then 'UNCERTAIN_RULE_EVIDENCE' when conf < need then 'LOW_CONFIDENCE' end reason from t)
      select event_id, case when reason is null then 'RESOLVED' else 'NEEDS_REVIEW' end status, case when gated then 'NO_CONTACT' when reason is null then case rule when 'KEEN' then 'COMMITTED' else 'UPSET' end end code, case when gated then 1.0 when reason is null then conf end::double confidence, reason review_reason, case when gated then 'NO_CONNECTION' when reason is null then rule end matched_rule from z""",
)
def dispositions(spark, sf_dir):
    """Combinators inside combinators are unknown here: the nested rule and the negated one never match."""
    e = F.col("event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        F.when(e % 17 == 0, "FAILED").when(e % 5 == 0, "OK").alias("line"),
        F.when(e % 23 != 0, F.struct(((e * 7 % 101) / 100).alias("p_yes"), ((50 + e * 11 % 50) / 100).alias("confidence"))).alias("commitment"),
        F.struct(((e * 13 % 101) / 100).alias("value"), ((50 + e * 19 % 50) / 100).alias("confidence")).alias("mood"),
    )
    return disposition.resolve(rows, disposition.compile_config(CONFIG)).select("event_id", "status", "code", "confidence", "review_reason", "matched_rule")


_LINES = """p as (select conv_id call_id, turn, role, string_split(text, chr(10)) ls from conversations), l as (select call_id, turn, role, unnest(range(1, len(ls) + 1)) n, unnest(ls) t from p)"""


@query("speaker_turns", f"with {_LINES}, k as (select *, sum(case when (turn % 3 = 2) then 1 else 0 end) over (partition by call_id order by turn, n) x from l where trim(t) <> ''), g as (select call_id, turn, role, case when turn % 3 = 2 then x else 0 end grp, string_agg(t, chr(10) order by n) text, count(*) n_lines from k group by 1, 2, 3, 4) select call_id, role, length(text) chars, n_lines, md5(text) digest from g")
def speaker_turns(spark, sf_dir):
    """Lines of every turn as utterances; lines of each third turn have no speaker and stay alone."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    lines = c.select(F.col("conv_id").alias("call_id"), "turn", "role", F.posexplode(F.split("text", "\n")).alias("n", "text")).filter("trim(text) <> ''")
    at = (F.col("turn") * 10_000 + F.col("n")).cast("long")
    u = lines.select("call_id", at.alias("id"), "role", F.when(F.col("turn") % 3 != 2, F.concat(F.lit("s"), F.col("turn").cast("string"))).alias("speaker"), at.alias("start_ms"), at.alias("end_ms"), "text")
    return disposition.speaker_turns(u).select("call_id", "role", F.length("text").alias("chars"), F.size("ids").cast("long").alias("n_lines"), F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query(
    "turn_windows",
    """with recursive s as (select call_id, turn, text, start_ms, end_ms, case when lag(role) over (partition by call_id order by start_ms, end_ms, turn) = role then 0 else 1 end k from v_utterances),
      g as (select *, sum(k) over (partition by call_id order by start_ms, end_ms, turn rows between unbounded preceding and current row) g from s),
      t as (select call_id, g::int i, (sum(length(text)) + count(*) - 1)::bigint n from g group by 1, 2),
      fit as (select call_id from t group by 1 having sum(n) <= 100000 and (max(n) <= 2000 or sum(n) <= 2000)),
      w as (select call_id, i, n, 0 as win, [i] as held, n as used from t where i = 1 and call_id in (select call_id from fit)
        union all select t.call_id, t.i, t.n, win + (used + t.n > 2000)::int, case when used + t.n <= 2000 then list_append(held, t.i) when w.n + t.n <= 2000 then [w.i, t.i] else [t.i] end,
          case when used + t.n <= 2000 then used + t.n when w.n + t.n <= 2000 then w.n + t.n else t.n end from w join t on t.call_id = w.call_id and t.i = w.i + 1)
      select call_id, win as "window", arg_max(held, i) turns from w where call_id in (select call_id from w group by 1 having max(win) < 128) group by 1, 2""",
)
def turn_windows(spark, sf_dir):
    u = _spoken(spark, sf_dir).withColumn("speaker", F.col("role"))
    return disposition.turn_windows(disposition.speaker_turns(u), 100_000, 2_000, 1, 128)


WINDOWS = {"context_limit_chars": 20_000, "window_chars": 4_000, "overlap_turns": 1, "max_chunks": 16}
CLASSES = CONFIG | {
    "questions": {"commitment": {"type": "noul"}, "mood": {"type": "score"}, "topic": {"type": "choice", "criteria": ["long", "short"]}},
    "resolver": {
        "default_emit": "REVIEW",
        "rules": [
            {"id": "KEEN", "priority": 1, "when": {"all": [{"signal": "commitment", "operator": "NOUL_GTE", "value": 0.6}, {"signal": "topic", "operator": "CHOICE_EQ", "value": "long"}]}, "emit": "COMMITTED"},
            {"id": "UPSET_CALL", "priority": 2, "when": {"signal": "mood", "operator": "SCORE_LTE", "value": 0.3}, "emit": "UPSET"},
            {"id": "SHORT", "priority": 3, "when": {"signal": "topic", "operator": "CHOICE_IN", "value": ["short"]}, "emit": "NEUTRAL"},
        ],
    },
    "confidence": {"default_commit_threshold": 0.7, "default_review_threshold": 0.45, "per_code": {"UPSET": {"commit_threshold": 0.85}}},
    "runtime": WINDOWS,
}


def vowels(questions: dict, texts: list[str]) -> dict:
    """A stand-in for the model: the share of vowels in the text, and its length."""
    t = " ".join(texts)
    share, long_ = sum(t.count(v) for v in "aeiouAEIOU") / max(1, len(t)), min(1.0, len(t) / 4000)
    topic = {"value": "long" if long_ >= 0.5 else "short", "probabilities": {"long": long_, "short": 1 - long_}, "confidence": max(long_, 1 - long_)}
    return {"commitment": {"p_yes": min(1.0, 2 * share), "confidence": 0.8}, "mood": {"value": share, "confidence": 0.9}, "topic": topic}


@query(
    "classified_calls",
    """with recursive u as (select * from v_utterances where role <> 'IVR' or call_id % 2 = 0),
      why as (select call_id, case when not bool_and(role in ('AGENT', 'CUSTOMER')) then 'UNCERTAIN_SPEAKER_ROLE' when not bool_and(length(trim(text)) > 0) then 'EMPTY_TRANSCRIPT_TURN' end reason from u group by 1),
      facts as (select distinct call_id, case when call_id % 5 <> 0 then case when call_id % 9 = 0 then 'NO_ANSWER' else 'OK' end end line from v_utterances),
      s as (select call_id, turn, text, start_ms, end_ms, case when lag(role) over (partition by call_id order by start_ms, end_ms, turn) = role then 0 else 1 end k from u where call_id in (select call_id from why where reason is null)),
      g as (select *, sum(k) over (partition by call_id order by start_ms, end_ms, turn rows between unbounded preceding and current row) g from s),
      t as (select call_id, g::int i, (sum(length(text)) + count(*) - 1)::bigint n, sum(length(text) - length(regexp_replace(text, '[aeiouAEIOU]', '', 'g')))::bigint v from g group by 1, 2),
      fit as (select call_id from t group by 1 having sum(n) <= 20000 and (max(n) <= 4000 or sum(n) <= 4000)),
      w as (select call_id, i, n, 0 as win, [i] as held, n as used from t where i = 1 and call_id in (select call_id from fit)
        union all select t.call_id, t.i, t.n, win + (used + t.n > 4000)::int, case when used + t.n <= 4000 then list_append(held, t.i) when w.n + t.n <= 4000 then [w.i, t.i] else [t.i] end,
          case when used + t.n <= 4000 then used + t.n when w.n + t.n <= 4000 then w.n + t.n else t.n end from w join t on t.call_id = w.call_id and t.i = w.i + 1),
      p as (select call_id, win, unnest(arg_max(held, i)) i from w where call_id in (select call_id from w group by 1 having max(win) < 16) group by 1, 2),
      q as (select p.call_id, p.win, sum(t.v)::double / greatest(1, sum(t.n) + count(*) - 1) share, least(1.0, (sum(t.n) + count(*) - 1) / 4000.0)::double l from p join t on t.call_id = p.call_id and t.i = p.i group by 1, 2),
      a as (select call_id, count(*) n, avg(least(1.0, 2 * share)) c, avg(share) m, min(greatest(l, 1 - l)) k, sum(l) sl, sum(1 - l) ss,
        max(least(1.0, 2 * share)) - min(least(1.0, 2 * share)) > 0.25 or max(share) - min(share) > 0.25 or count(distinct case when greatest(l, 1 - l) >= 0.45 then l >= 0.5 end) > 1 bad from q group by 1),
      r as (select f.call_id, line, reason, n, c, m, k, bad, case when sl >= ss then 'long' else 'short' end topic, u.call_id is not null spoken from facts f left join (select distinct call_id from u) u on u.call_id = f.call_id left join why on why.call_id = f.call_id left join a on a.call_id = f.call_id),
      d as (select *, case when line = 'NO_ANSWER' then 'NO_CONNECTION' when not spoken or reason is not null or n is null or bad then null when c >= 0.6 and topic = 'long' then 'KEEN' when m <= 0.3 then 'UPSET_CALL' when topic = 'short' then 'SHORT' end id from r),
      e as (select *, case id when 'NO_CONNECTION' then 1.0 when 'KEEN' then least(0.8, k) when 'UPSET_CALL' then 0.9 when 'SHORT' then k end conf, case id when 'UPSET_CALL' then 0.85 else 0.7 end least_conf from d),
      z as (select *, case when id = 'NO_CONNECTION' then null when not spoken then 'INCOMPLETE_TRANSCRIPT' when reason is not null then reason when n is null then 'CONTEXT_LIMIT' when bad then 'CONFLICTING_CHUNK_SIGNALS' when id is null then 'NO_RULE_MATCHED' when conf < least_conf then 'LOW_CONFIDENCE' end fault from e)
      select call_id, case when fault is null then 'RESOLVED' else 'NEEDS_REVIEW' end status, case when fault is null then case id when 'NO_CONNECTION' then 'NO_CONTACT' when 'KEEN' then 'COMMITTED' when 'UPSET_CALL' then 'UPSET' else 'NEUTRAL' end end code, case when fault is null then round(conf, 9) end confidence, fault review_reason, case when fault is null then id end matched_rule from z""",
)
def classified_calls(spark, sf_dir):
    """The whole classification, with facts, all three kinds of question and a stand-in for the model."""
    every = _spoken(spark, sf_dir)
    u = every.filter("role <> 'IVR' or call_id % 2 = 0").withColumn("speaker", F.col("role"))
    line = F.when(F.col("call_id") % 5 != 0, F.when(F.col("call_id") % 9 == 0, "NO_ANSWER").otherwise("OK"))
    facts = every.select("call_id").distinct().withColumn("line", line)
    return disposition.classify(u, disposition.compile_config(CLASSES), vowels, facts).withColumn("confidence", F.round("confidence", 9))
