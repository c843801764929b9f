"""Queries over calls, audits, reviews and findings."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from callgrid.operators import audit, evaluation, latest, operations, reports
from callgrid.operators.scope import Scope, resolve_memberships, scoped
from callgrid.plans.catalog import query
from callgrid.sources.derived import view

_UTC = timezone.utc
LEADER = Scope("org-1", "agent-1", "TEAM_LEADER", tuple(f"team-{i}" for i in range(25)))
ANALYST, AGENT, OFFICER = Scope("org-1", "qa", "QA_ANALYST"), Scope("org-1", "agent-7", "AGENT"), Scope("org-1", "co", "COMPLIANCE_OFFICER")

#: Current audits (newest of a call, of the call's transcript) and latest reviews, for the SQL below.
_CURRENT = """cur as (select * from (select c.organisation_id, c.call_id, c.agent_id, c.team_id, c.created_at, c.transcript_revision, c.processing_state,
    a.revision, a.audit_id, a.transcript_revision ar, a.rubric_version, a.model_artifact, a.overall_score, a.decision
    from v_calls c join v_audits a on a.call_id = c.call_id where c.tombstoned_at is null and a.revision = (select max(m.revision) from v_audits m where m.call_id = a.call_id)) x where ar = transcript_revision),
  head as (select * from v_reviews r where r.version = (select max(m.version) from v_reviews m where m.audit_id = r.audit_id))"""


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


@query(
    "team_report",
    f"""with {_CURRENT}, g as (select team_id, rubric_version, model_artifact, count(distinct agent_id) agents, count(*) n, count(overall_score) mn, round(avg(cast(overall_score as double)), 6) ma,
      count(effective_score) rn, round(avg(cast(effective_score as double)), 6) ra, count(*) filter (where decision = 'PASS') mp, count(*) filter (where decision = 'FAIL') mf,
      count(*) filter (where effective_decision = 'PASS') rp, count(*) filter (where effective_decision = 'FAIL') rf
      from cur left join head on head.audit_id = cur.audit_id where organisation_id = 'org-1' and created_at >= timestamp '1998-01-01' and created_at < timestamp '1999-01-01' group by all)
    select team_id, rubric_version, model_artifact, agents < 5 suppressed, case when agents < 5 then 'MINIMUM_AGENT_THRESHOLD' end suppression_reason,
      case when agents >= 5 then agents end distinct_agents, case when agents >= 5 then n end sample_count, case when agents >= 5 then mn end machine_sample_count, case when agents >= 5 then ma end machine_average,
      case when agents >= 5 then rn end reviewed_sample_count, case when agents >= 5 then ra end reviewed_average, case when agents >= 5 then mp end machine_pass_count, case when agents >= 5 then mf end machine_fail_count,
      case when agents >= 5 then rp end reviewed_pass_count, case when agents >= 5 then rf end reviewed_fail_count from g""",
)
def team_report(spark, sf_dir):
    v = lambda n: view(spark, sf_dir, n)
    return reports.team_report(v("v_calls"), v("v_audits"), v("v_reviews"), LEADER, datetime(1998, 1, 1, tzinfo=_UTC), datetime(1999, 1, 1, tzinfo=_UTC))


@query(
    "review_queue",
    f"""with {_CURRENT} select call_id, audit_id, decision, cast(overall_score as double) machine_score, processing_state, agent_id, team_id, strftime(created_at, '%Y-%m-%d') created, transcript_revision, revision
      from cur where organisation_id = 'org-1' and not exists (select 1 from head where head.audit_id = cur.audit_id and effective_decision <> 'NEEDS_REVIEW')
      order by case decision when 'NEEDS_REVIEW' then 0 when 'FAIL' then 1 else 2 end, created_at desc, audit_id limit 100""",
)
def review_queue(spark, sf_dir):
    rows = reports.review_queue(view(spark, sf_dir, "v_calls"), view(spark, sf_dir, "v_audits"), view(spark, sf_dir, "v_reviews"), ANALYST, 100)
    return rows.select("call_id", "audit_id", "decision", F.col("overall_score").cast("double").alias("machine_score"), "processing_state", "agent_id", "team_id", _day("created_at").alias("created"), "transcript_revision", "revision")


@query("review_queue_kpi", f"with {_CURRENT} select decision, count(*) n from cur where organisation_id = 'org-1' and not exists (select 1 from head where head.audit_id = cur.audit_id and effective_decision <> 'NEEDS_REVIEW') group by 1")
def review_queue_kpi(spark, sf_dir):
    settled = latest.latest_reviews(view(spark, sf_dir, "v_reviews")).filter("effective_decision <> 'NEEDS_REVIEW'")
    rows = latest.current_audits(scoped(view(spark, sf_dir, "v_calls"), ANALYST).filter("tombstoned_at is null"), view(spark, sf_dir, "v_audits"))
    return rows.join(settled, "audit_id", "left_anti").groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query(
    "own_scores",
    f"""with {_CURRENT} select cur.call_id, cur.audit_id, strftime(created_at, '%Y-%m-%d') created, revision, cast(overall_score as double) machine_score, decision, version, action, cast(effective_score as double) reviewed_score, effective_decision
      from cur join head on head.audit_id = cur.audit_id where organisation_id = 'org-1' and effective_score is not null and action in ('ACCEPT', 'OVERRIDE') and agent_id = (select min(agent_id) from v_calls where organisation_id = 'org-1')
      order by created_at desc, cur.audit_id limit 500""",
)
def own_scores(spark, sf_dir):
    calls = view(spark, sf_dir, "v_calls")
    # the tenant's first agent, as a table of one row
    first = calls.filter("organisation_id = 'org-1'").agg(F.min("agent_id").alias("agent_id"))
    mine = calls.join(first, "agent_id", "left_semi").withColumn("agent_id", F.lit("me"))
    rows = reports.own_scores(mine, view(spark, sf_dir, "v_audits"), view(spark, sf_dir, "v_reviews"), Scope("org-1", "me", "AGENT"))
    return rows.select("call_id", "audit_id", _day("created_at").alias("created"), "revision", F.col("overall_score").cast("double").alias("machine_score"), "decision", "version", "action", F.col("effective_score").cast("double").alias("reviewed_score"), "effective_decision")


@query("own_scores_average", f"with {_CURRENT} select agent_id, count(*) n, ((2 * sum(cast(effective_score * 100 as bigint)) + count(*)) // (2 * count(*))) / 100.0::double average from cur join head on head.audit_id = cur.audit_id where organisation_id = 'org-1' and effective_score is not null and action in ('ACCEPT', 'OVERRIDE') group by 1")
def own_scores_average(spark, sf_dir):
    final = latest.latest_reviews(view(spark, sf_dir, "v_reviews")).filter("effective_score is not null and action in ('ACCEPT', 'OVERRIDE')").drop("call_id")
    rows = latest.current_audits(scoped(view(spark, sf_dir, "v_calls"), ANALYST).filter("tombstoned_at is null"), view(spark, sf_dir, "v_audits")).join(final, "audit_id")
    return rows.groupBy("agent_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("effective_score").cast("decimal(6,2)")) / F.count(F.lit(1)), 2).cast("double").alias("average"))


@query(
    "findings_export",
    """select cast(c.call_id as varchar) call_id, team_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' call_created_at, rule_id, ruleset_version, status, severity, cast(deadline_ms as varchar) deadline_ms, remediation
      from v_calls c join v_findings f on f.call_id = c.call_id and f.transcript_revision = c.transcript_revision where organisation_id = 'org-1' and tombstoned_at is null and created_at >= timestamp '1998-01-01' and created_at < timestamp '1998-03-01'
      order by created_at, c.call_id, rule_id limit 10001""",
)
def findings_export(spark, sf_dir):
    return reports.findings_export(view(spark, sf_dir, "v_calls"), view(spark, sf_dir, "v_findings"), OFFICER, datetime(1998, 1, 1, tzinfo=_UTC), datetime(1998, 3, 1, tzinfo=_UTC))


@query(
    "call_detail",
    """with top as (select * from v_audits a where revision = (select max(m.revision) from v_audits m where m.call_id = a.call_id)), n as (select audit_id, max(version) v, count(*) k from v_reviews group by 1),
      f as (select call_id, transcript_revision, count(*) nf from v_findings group by 1, 2)
      select c.call_id, top.audit_id, top.revision audit_revision, top.decision, coalesce(top.transcript_revision <> c.transcript_revision, true) superseded, coalesce(k, 0) n_reviews, coalesce(v, 0) current_review_version, coalesce(nf, 0) n_findings
      from v_calls c left join top on top.call_id = c.call_id left join n on n.audit_id = top.audit_id left join f on f.call_id = c.call_id and f.transcript_revision = c.transcript_revision where c.organisation_id = 'org-1' and c.tombstoned_at is null""",
)
def call_detail(spark, sf_dir):
    v = lambda n: view(spark, sf_dir, n)
    rows = reports.call_detail(v("v_calls"), v("v_audits"), v("v_reviews"), v("v_findings"), ANALYST)
    return rows.select("call_id", "audit_id", "audit_revision", "decision", "superseded", F.coalesce("n_reviews", F.lit(0)).alias("n_reviews"), F.col("current_review_version"), F.coalesce(F.size("findings"), F.lit(0)).alias("n_findings"))


@query("scoped_calls", "select role, count(*) n from (select 'AGENT' as role, call_id from v_calls where organisation_id = 'org-1' and agent_id = 'agent-7' union all select 'TEAM_LEADER', call_id from v_calls where organisation_id = 'org-1' and team_id in ('team-1', 'team-6') union all select 'QA_ANALYST', call_id from v_calls where organisation_id = 'org-1') x group by 1")
def scoped_calls(spark, sf_dir):
    calls = view(spark, sf_dir, "v_calls")
    parts = [scoped(calls, s).select(F.lit(s.role).alias("role")) for s in (AGENT, Scope("org-1", "x", "TEAM_LEADER", ("team-1", "team-6")), ANALYST)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query(
    "memberships",
    """with g as (select subject, count(distinct (organisation_id, user_id, role)) k, min(organisation_id) organisation_id, min(user_id) user_id, min(role) as role, list_sort(list_distinct(list(team_id) filter (where team_id is not null))) t from v_memberships where is_active group by 1)
      select subject, organisation_id, user_id, role, coalesce(array_to_string(t, ','), '') teams from g where k = 1 and case role when 'AGENT' then coalesce(len(t), 0) = 1 when 'TEAM_LEADER' then coalesce(len(t), 0) >= 1 else true end""",
)
def memberships(spark, sf_dir):
    return resolve_memberships(view(spark, sf_dir, "v_memberships")).select("subject", "organisation_id", "user_id", "role", F.array_join("team_ids", ",").alias("teams"))


@query("operations_summary", "select (select count(*) from v_jobs j where state in ('QUEUED', 'RETRY_WAIT', 'RUNNING') and exists (select 1 from v_calls c where c.call_id = j.call_id and tombstoned_at is null)) pending_jobs, (select least(31536000, greatest(0, floor((1706572800000000 - min(available_us)) / 1000000)))::bigint from v_jobs j where state in ('QUEUED', 'RETRY_WAIT', 'RUNNING') and exists (select 1 from v_calls c where c.call_id = j.call_id and tombstoned_at is null)) oldest_age_s, (select count(*) from v_calls where tombstoned_at is null and processing_state <> 'READY') incomplete_calls")
def operations_summary(spark, sf_dir):
    return operations.summary(view(spark, sf_dir, "v_calls"), view(spark, sf_dir, "v_jobs"), 1706572800000000)


@query("due_jobs", "select job_id, stage, attempts, least(300, cast(pow(2, greatest(0, attempts - 1)) as int)) backoff_s from v_jobs where ((state in ('QUEUED', 'RETRY_WAIT') and available_us <= 1706000000000000) or (state = 'RUNNING' and lease_us < 1706000000000000)) and attempts < 3 order by available_us, job_id limit 100")
def due_jobs(spark, sf_dir):
    from callgrid.functions.text import backoff_seconds

    return operations.due_jobs(view(spark, sf_dir, "v_jobs"), 1706000000000000, 100).select("job_id", "stage", "attempts", backoff_seconds(F.col("attempts")).alias("backoff_s"))


@query("exhausted_calls", "select call_id from v_calls where call_id in (select call_id from v_jobs where state = 'RUNNING' and attempts >= 3 and lease_us < 1706000000000000)")
def exhausted_calls(spark, sf_dir):
    return operations.exhausted(view(spark, sf_dir, "v_jobs"), view(spark, sf_dir, "v_calls"), 1706000000000000).select("call_id")


@query("retention_due", "select call_id, strftime(created_at + interval 90 day, '%Y-%m-%d') expires from v_calls where call_id % 5 <> 0 and created_at + interval 90 day <= timestamp '1998-06-01' order by created_at, call_id limit 100")
def retention_due(spark, sf_dir):
    calls = view(spark, sf_dir, "v_calls").withColumn("legal_hold", F.col("call_id") % 5 == 0).withColumn("retention_expires_at", F.col("created_at") + F.expr("interval 90 days"))
    return operations.retention_due(calls, F.to_timestamp_ntz(F.lit("1998-06-01 00:00:00"))).select("call_id", _day("retention_expires_at").alias("expires"))


@query("purge_dependants", "with k as (select call_id from v_calls where tombstoned_at is not null) select 'audits' kind, count(*) n from v_audits where call_id in (select call_id from k) union all select 'findings', count(*) from v_findings where call_id in (select call_id from k) union all select 'reviews', count(*) from v_reviews where call_id in (select call_id from k)")
def purge_dependants(spark, sf_dir):
    v = lambda n: view(spark, sf_dir, n)
    return operations.dependants(v("v_calls").filter("tombstoned_at is not null"), audits=v("v_audits"), findings=v("v_findings"), reviews=v("v_reviews"))


_WEIGHT = "case dim when 1 then 10 when 2 then 15 when 3 then 25 when 4 then 20 else 10 end"


@query("weighted_scores", f"select call_id, case when count(*) filter (where not not_applicable and score is null) = 0 then round(sum(case when not not_applicable then score * {_WEIGHT} end) / sum(case when not not_applicable then {_WEIGHT} end), 2) end score from (select o_orderkey call_id, dim, score, not_applicable from v_scores) x group by 1".replace("select o_orderkey call_id, dim, score, not_applicable from v_scores", "select * from v_scores"))
def weighted_scores(spark, sf_dir):
    return audit.weighted_scores(view(spark, sf_dir, "v_scores")).withColumn("score", F.col("score").cast("double"))


@query(
    "audit_decisions",
    f"""with s as (select call_id, case when count(*) filter (where not not_applicable and score is null) = 0 then round(sum(case when not not_applicable then score * {_WEIGHT} end) / sum(case when not not_applicable then {_WEIGHT} end), 2) end score from v_scores group by 1),
      r as (select s.call_id, c.transcript_revision, score, exists (select 1 from v_findings f where f.call_id = c.call_id and f.transcript_revision = c.transcript_revision and severity = 'HIGH' and status in ('UNKNOWN', 'POTENTIAL_VIOLATION')) crit from s join v_calls c on c.call_id = s.call_id)
      select call_id, case when crit then 'UNRESOLVED_CRITICAL_FINDING' when score is null then 'INSUFFICIENT_EVIDENCE' end review_reason, case when crit or score is null then 'NEEDS_REVIEW' when score >= 3.0 then 'PASS' else 'FAIL' end decision from r""",
)
def audit_decisions(spark, sf_dir):
    scored = audit.weighted_scores(view(spark, sf_dir, "v_scores")).join(view(spark, sf_dir, "v_calls").select("call_id", "transcript_revision"), "call_id")
    return audit.decided(scored, view(spark, sf_dir, "v_findings"), 3.0).select("call_id", "review_reason", "decision")


@query("audit_preconditions", "with u as (select call_id, bool_and(turn % 29 <> 0 or turn = 0) final, sum(length(text))::bigint chars from v_utterances group by 1), f as (select call_id, count(*) n from v_findings group by 1), c as (select distinct conv_id call_id from conversations) select c.call_id, case when u.final is null or not u.final then 'INCOMPLETE_TRANSCRIPT' when chars > 100000 then 'CONTEXT_LIMIT' when n is null then 'POLICY_STAGE_INCOMPLETE' when c.call_id % 9 = 0 then 'POLICY_PROVENANCE_MISSING' end reason from c left join u on u.call_id = c.call_id left join f on f.call_id = c.call_id")
def audit_preconditions(spark, sf_dir):
    u = view(spark, sf_dir, "v_utterances").withColumn("is_final", (F.col("turn") % 29 != 0) | (F.col("turn") == 0))
    f = view(spark, sf_dir, "v_findings").withColumn("ruleset_hash", F.when(F.col("call_id") % 9 == 0, "bad").otherwise(F.repeat(F.lit("0"), 64)))
    return audit.preconditions(u.select("call_id").distinct(), u, f)


@query("audit_provenance", "with p as (select call_id, list_sort(list_distinct(list(ruleset_version))) vs from v_findings group by 1) select call_id, sha256('[' || array_to_string(list_transform(vs, lambda v: '{\"hash\":\"' || sha256(v) || '\",\"version\":\"' || v || '\"}'), ',') || ']') fingerprint from p")
def audit_provenance(spark, sf_dir):
    return audit.provenance(view(spark, sf_dir, "v_findings").withColumn("ruleset_hash", F.sha2("ruleset_version", 256))).select("call_id", "fingerprint")


@query(
    "review_effects",
    f"""with sc as (select call_id, list(case when not_applicable then -1 when score is null then -2 else score end order by dim) v from v_scores group by 1),
      m as (select v_calls.call_id, v_calls.transcript_revision, v, case when list_contains(v, -2) then null else round((10*v[1]+15*v[2]+25*v[3]+20*v[4]+10*v[5]+(case when v[6] = -1 then 0 else 10*v[6] end)+10*v[7]) / (case when v[6] = -1 then 90 else 100 end), 2) end ms from v_calls join sc on sc.call_id = v_calls.call_id),
      q as (select *, case when ms is null then 'NEEDS_REVIEW' when ms >= 3.0 then 'PASS' else 'FAIL' end md, case call_id % 3 when 0 then 'ACCEPT' when 1 then 'OVERRIDE' else 'TRIAGE' end act, 1 + call_id % 5 new_resolution,
        exists (select 1 from v_findings f where f.call_id = m.call_id and f.transcript_revision = m.transcript_revision and severity = 'HIGH' and status in ('UNKNOWN', 'POTENTIAL_VIOLATION')) crit from m),
      e as (select *, case when act = 'TRIAGE' and md <> 'NEEDS_REVIEW' then 'TRIAGE_NOT_NEEDED' when act = 'ACCEPT' and (ms is null or md = 'NEEDS_REVIEW') then 'INCOMPLETE_AUDIT' when act = 'OVERRIDE' and (ms is null or md = 'NEEDS_REVIEW') then 'INCOMPLETE_AUDIT' end error,
        round((10*v[1]+15*v[2]+25*new_resolution+20*v[4]+10*v[5]+(case when v[6] = -1 then 0 else 10*v[6] end)+10*v[7]) / (case when v[6] = -1 then 90 else 100 end), 2) os from q)
      select call_id, act as action, error, case when error is null and act = 'ACCEPT' then ms when error is null and act = 'OVERRIDE' then os end effective_score,
        case when error is not null then null when act = 'TRIAGE' then 'NEEDS_REVIEW' when act = 'ACCEPT' then md when crit then 'NEEDS_REVIEW' when os >= 3.0 then 'PASS' else 'FAIL' end effective_decision from e""",
)
def review_effects(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in audit.WEIGHTS])
    entry = F.struct(F.element_at(names, F.col("dim")).alias("key"), F.when(F.col("not_applicable"), "NOT_APPLICABLE").otherwise(F.col("score").cast("string")).alias("value"))
    vectors = view(spark, sf_dir, "v_scores").groupBy("call_id").agg(F.map_from_entries(F.collect_list(entry)).alias("machine_scores"))
    calls = view(spark, sf_dir, "v_calls").select("call_id", "transcript_revision")
    critical = audit.unresolved_critical(view(spark, sf_dir, "v_findings")).withColumn("critical", F.lit(True))
    rows = calls.join(vectors, "call_id").join(critical, ["call_id", "transcript_revision"], "left").withColumn("critical", F.coalesce("critical", F.lit(False)))
    score = audit.weighted_score(F.col("machine_scores"))
    rows = rows.withColumn("machine_score", score).withColumn("machine_decision", F.when(F.col("machine_score").isNull(), "NEEDS_REVIEW").when(F.col("machine_score") >= 3.0, "PASS").otherwise("FAIL"))
    act = F.when(F.col("call_id") % 3 == 0, "ACCEPT").when(F.col("call_id") % 3 == 1, "OVERRIDE").otherwise("TRIAGE")
    rows = rows.withColumns(
        {
            "action": act, "head_action": F.lit(None).cast("string"), "head_score": F.lit(None).cast("double"), "head_decision": F.lit(None).cast("string"), "head_scores": F.lit(None).cast("map<string,string>"),
            "changed_scores": F.when(act == "OVERRIDE", F.create_map(F.lit("resolution"), (1 + F.col("call_id") % 5).cast("string"))).otherwise(F.create_map().cast("map<string,string>")),
        }
    )
    return audit.review_effects(rows, F.lit(3.0)).select("call_id", "action", "error", F.col("effective_score").cast("double").alias("effective_score"), "effective_decision")


@query("next_revisions", "select call_id, cast(coalesce(m, 0) + row_number() over (partition by b.call_id order by job_id) as int) revision, job_id from (select call_id, job_id from v_jobs where state = 'DONE') b left join (select call_id c, max(revision) m from v_audits group by 1) a on c = b.call_id")
def next_revisions(spark, sf_dir):
    batch = view(spark, sf_dir, "v_jobs").filter("state = 'DONE'").select("call_id", "job_id")
    return latest.next_revision(view(spark, sf_dir, "v_audits"), batch, ["call_id"], "job_id").select("call_id", "revision", "job_id")


@query("latest_review", "select audit_id, version, action from v_reviews r where version = (select max(m.version) from v_reviews m where m.audit_id = r.audit_id)")
def latest_review(spark, sf_dir):
    return latest.latest_reviews(view(spark, sf_dir, "v_reviews")).select("audit_id", "version", "action")


@query("evaluation_by_rule", "with p as (select distinct * from v_predicted), j as (select coalesce(g.rule_id, p.rule_id) rule_id, g.case_id is not null g, p.case_id is not null p, coalesce(critical, false) c from v_gold g full join p on p.case_id = g.case_id and p.rule_id = g.rule_id), s as (select rule_id, count(*) filter (where g and p) tp, count(*) filter (where not g and p) fp, count(*) filter (where g and not p) fn, count(*) filter (where c) critical_gold, count(*) filter (where c and not p) critical_missed from j group by 1) select *, case when tp + fp > 0 then tp / (tp + fp) end as precision, case when tp + fn > 0 then tp / (tp + fn) end recall from s")
def evaluation_by_rule(spark, sf_dir):
    return evaluation.by_rule(view(spark, sf_dir, "v_gold"), view(spark, sf_dir, "v_predicted"))


@query("evaluation_report", "with e as (select * from v_cases where not excluded), c as (select count(*) total, count(*) filter (where excluded) explicitly_excluded, count(*) filter (where not excluded) eligible, count(*) filter (where not excluded and abstained) abstained from v_cases), d as (select count(*) applicable_dimensions, count(predicted) filter (where not abstained) adjudicated_dimensions, round(avg(abs(predicted - gold)) filter (where not abstained), 6) mean_absolute_error, count(*) filter (where not abstained and predicted = gold) exact_matches from e) select *, eligible - abstained covered, (eligible - abstained) / eligible coverage, applicable_dimensions - adjudicated_dimensions excluded_dimensions, exact_matches / adjudicated_dimensions exact_agreement from c, d")
def evaluation_report(spark, sf_dir):
    c = view(spark, sf_dir, "v_cases")
    return evaluation.report(c.select("case_id", "excluded", "abstained"), c.select("case_id", "gold", "predicted"))


@query(
    "version_status",
    """with act as (select config_id, max(version) version from v_versions where version <= 3 group by 1), ap as (select e.config_id, e.version, arg_min(e.actor, e.at_) by_ from v_config_events e join v_versions v on v.config_id = e.config_id and v.version = e.version where e.action = 'APPROVED' and e.actor <> v.actor group by 1, 2)
      select v.config_id, v.version, case when act.version is not null then 'ACTIVE' when exists (select 1 from v_config_events e where e.config_id = v.config_id and e.version = v.version and action = 'ACTIVATED') then 'RETIRED' when ap.by_ is not null then 'APPROVED' else 'STAGED' end status, ap.by_ approved_by
      from v_versions v left join act on act.config_id = v.config_id and act.version = v.version left join ap on ap.config_id = v.config_id and ap.version = v.version""",
)
def version_status(spark, sf_dir):
    versions = view(spark, sf_dir, "v_versions")
    active = versions.filter("version <= 3").groupBy("config_id").agg(F.max("version").alias("version"))
    return operations.version_status(versions, active, view(spark, sf_dir, "v_config_events"))


@query("idempotent_insert", "select b.call_id, b.revision, case when a.decision is null then 'NEW' when a.decision = b.decision then 'SAME' else 'CONFLICT' end outcome from (select call_id, revision, case when call_id % 3 = 0 then 'PASS' else decision end decision from v_audits) b left join (select call_id, revision, decision from v_audits where decision <> 'NEEDS_REVIEW') a on a.call_id = b.call_id and a.revision = b.revision")
def idempotent_insert(spark, sf_dir):
    """All audits arrive; those that were decided are there already."""
    a = view(spark, sf_dir, "v_audits").select("call_id", "revision", "decision")
    batch = a.withColumn("decision", F.when(F.col("call_id") % 3 == 0, "PASS").otherwise(F.col("decision")))
    return operations.inserted(a.filter("decision <> 'NEEDS_REVIEW'"), batch, ["call_id", "revision"], "decision").select("call_id", "revision", "outcome")


@query("findings_upsert", "select call_id, transcript_revision, rule_id, case when severity = 'HIGH' then 'RESOLVED' else status end status from v_findings")
def findings_upsert(spark, sf_dir):
    """The findings of all revisions, after a batch that resolves the severe ones."""
    f = view(spark, sf_dir, "v_findings")
    own = ["call_id", "transcript_revision", "rule_id", "status"]
    return operations.upserted(f.select(*own), f.filter("severity = 'HIGH'").withColumn("status", F.lit("RESOLVED")).select(*own), own[:3])


@query("latest_dispositions", "with d as (select *, row_number() over (partition by a.call_id order by a.revision desc) r from v_audits a join (select call_id own, transcript_revision own_revision from v_calls) c on c.own = a.call_id and c.own_revision = a.transcript_revision) select c.call_id, d.revision, coalesce(d.decision, 'PENDING') status, d.rubric_version config_id from v_calls c left join d on d.call_id = c.call_id and d.r = 1")
def latest_dispositions(spark, sf_dir):
    """The newest decision on each call's own transcript; audits stand in for dispositions."""
    d = view(spark, sf_dir, "v_audits").select("call_id", "transcript_revision", "revision", F.col("decision").alias("status"), F.col("rubric_version").alias("config_id"))
    return latest.latest_dispositions(view(spark, sf_dir, "v_calls"), d).select("call_id", "revision", "status", "config_id")


@query(
    "own_scores_notes",
    f"""with {_CURRENT} select cur.audit_id, len(string_split(remarks, '|')) n_checklist, len(list_filter(string_split(remarks, '|'), lambda r: r = 'call [REDACTED] now')) n_redacted, case when version % 2 = 0 then 3 else 2 end n_notes, case when version % 2 = 0 then 'seen by [REDACTED]' end last_note
      from (select *, case when audit_id % 3 = 0 then 'fine|call [REDACTED] now' else 'fine' end remarks from cur) cur join head on head.audit_id = cur.audit_id where organisation_id = 'org-1' and effective_score is not null and action in ('ACCEPT', 'OVERRIDE')""",
)
def own_scores_notes(spark, sf_dir):
    """Settled scores of a tenant's calls with checklist and notes, redacted."""
    from callgrid.operators import privacy

    calls = view(spark, sf_dir, "v_calls").filter("organisation_id = 'org-1'").withColumn("agent_id", F.lit("me"))
    rows = reports.own_scores(calls, view(spark, sf_dir, "v_audits"), view(spark, sf_dir, "v_reviews"), Scope("org-1", "me", "AGENT"), limit=2**31 - 1)
    dimension = lambda i, reason: F.struct(F.lit(i).alias("id"), F.lit("SCORED").alias("status"), F.lit(4).alias("score"), F.lit(reason).alias("reason"))
    text = lambda t: F.struct(F.lit(t).alias("text"))
    both, one = F.array(dimension("greeting", "fine"), dimension("closing", "call 0151 2345 6789 now")), F.array(dimension("greeting", "fine"))
    rows = rows.withColumns({"dimensions": F.when(F.col("audit_id") % 3 == 0, both).otherwise(one), "reviewed_scores": F.create_map(F.lit("greeting"), F.lit(5)), "coaching_narrative": text("well done"), "highlights": F.array(text("calm")), "improvement_areas": F.array(text("")), "note": F.when(F.col("version") % 2 == 0, "seen by a.b@example.org")})
    rows = reports.with_notes(rows, privacy.redacted)
    last = F.try_element_at(F.filter("notes", lambda n: n["kind"] == "human_review"), F.lit(1))["text"]
    return rows.select("audit_id", F.size("checklist").cast("long").alias("n_checklist"), F.size(F.filter("checklist", lambda c: c["reason"] == "call [REDACTED] now")).cast("long").alias("n_redacted"), F.size("notes").alias("n_notes"), last.alias("last_note"))
