"""Reports over calls, audits, reviews and findings."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrid.functions.text import csv_cell, iso_utc
from callgrid.operators.latest import current_audits, latest_reviews
from callgrid.operators.scope import Scope, alive, between, require, scoped

# fixed values of the reports: row caps, day caps, and the smallest group that is shown
MAX_OWN_ROWS, MAX_EXPORT_ROWS, MAX_REPORT_DAYS, MAX_EXPORT_DAYS, MIN_AGENTS = 500, 10_000, 366, 92, 5


def team_report(calls: DataFrame, audits: DataFrame, reviews: DataFrame, scope: Scope, start: datetime, end: datetime) -> DataFrame:
    """Machine and reviewed scores by team, rubric and model; groups of fewer than MIN_AGENTS agents show
    no figures."""
    require(scope, "TEAM_LEADER")
    seen = scoped(calls, scope).filter(alive()).filter(between("created_at", start, end, MAX_REPORT_DAYS))
    rows = current_audits(seen, audits)
    rows = rows.join(latest_reviews(reviews, seen).select("audit_id", "effective_score", "effective_decision"), "audit_id", "left")
    average = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    figures = {
        "distinct_agents": F.countDistinct("agent_id"),
        "sample_count": F.count(F.lit(1)),
        "machine_sample_count": F.count("overall_score"),
        "machine_average": average("overall_score"),
        "reviewed_sample_count": F.count("effective_score"),
        "reviewed_average": average("effective_score"),
        "machine_pass_count": F.count_if(F.col("decision") == "PASS"),
        "machine_fail_count": F.count_if(F.col("decision") == "FAIL"),
        "reviewed_pass_count": F.count_if(F.col("effective_decision") == "PASS"),
        "reviewed_fail_count": F.count_if(F.col("effective_decision") == "FAIL"),
    }
    groups = ["team_id", "rubric_version", "model_artifact"]
    table = rows.groupBy(*groups).agg(*[c.alias(n) for n, c in figures.items()])
    hidden = F.col("distinct_agents") < MIN_AGENTS
    return table.select(*groups, hidden.alias("suppressed"), F.when(hidden, "MINIMUM_AGENT_THRESHOLD").alias("suppression_reason"), *[F.when(~hidden, F.col(n)).alias(n) for n in figures])


def review_queue(calls: DataFrame, audits: DataFrame, reviews: DataFrame, scope: Scope, limit: int = 50) -> DataFrame:
    """Current audits that no review has settled, those that need review first."""
    require(scope, "QA_ANALYST", "ADMIN")
    if not 1 <= limit <= 100:
        raise ValueError("the limit is 1 to 100")
    seen = scoped(calls, scope).filter(alive())
    settled = latest_reviews(reviews, seen).filter("effective_decision <> 'NEEDS_REVIEW'").select("audit_id")
    urgency = F.when(F.col("decision") == "NEEDS_REVIEW", 0).when(F.col("decision") == "FAIL", 1).otherwise(2)
    rows = current_audits(seen, audits).join(settled, "audit_id", "left_anti")
    return rows.orderBy(urgency, F.desc("created_at"), "audit_id").limit(limit)


def own_scores(calls: DataFrame, audits: DataFrame, reviews: DataFrame, scope: Scope, limit: int = MAX_OWN_ROWS) -> DataFrame:
    """An agent's current audits whose latest review confirms or changes the score."""
    require(scope, "AGENT")
    seen = scoped(calls, scope).filter(alive())
    final = latest_reviews(reviews, seen).filter("effective_score is not null and action in ('ACCEPT', 'OVERRIDE')").drop("call_id")
    rows = current_audits(seen, audits).join(final, "audit_id")
    return rows.orderBy(F.desc("created_at"), "audit_id").limit(limit)


def checklist(dimensions: str, reviewed: str, redact=lambda c: c) -> Column:
    """Scored dimensions beside the reviewed score of the same dimension, reasons redacted. redact works
    on columns of texts; one in Python is applied to the joined rows of arrays before."""
    return F.transform(dimensions, lambda d: F.struct(d["id"].alias("id"), d["status"].alias("status"), d["score"].alias("machine_score"), F.try_element_at(F.col(reviewed), d["id"]).alias("reviewed_score"), redact(F.coalesce(d["reason"], F.lit(""))).alias("reason")))


def coaching_notes(narrative: str, highlights: str, improvements: str, review: str, redact=lambda c: c) -> Column:
    """Notes that are not empty, in order: the coaching text, highlights, improvements, the human review.
    All but the review are arrays or structs with a field `text`."""
    note = lambda kind, source, t: F.struct(F.lit(kind).alias("kind"), F.lit(source).alias("source"), t.alias("text"))
    many = lambda kind, c: F.transform(F.coalesce(c, F.array().cast("array<struct<text:string>>")), lambda n: note(kind, "machine_audit", n["text"]))
    every = F.concat(F.array(note("coaching", "machine_audit", F.col(narrative)["text"])), many("highlight", F.col(highlights)), many("improvement", F.col(improvements)), F.array(note("human_review", "latest_review", F.col(review))))
    told = F.filter(every, lambda n: F.coalesce(n["text"], F.lit("")) != "")
    return F.transform(told, lambda n: F.struct(n["kind"].alias("kind"), n["source"].alias("source"), redact(n["text"]).alias("text")))


def with_notes(rows: DataFrame, redact_text=None) -> DataFrame:
    """Own scores with a checklist and coaching notes from the columns dimensions, reviewed_scores, coaching_narrative,
    highlights, improvement_areas and note. redact_text: a plain function of a text, run over all notes of a
    batch at once; anything that it raises fails the query."""
    rows = rows.withColumns({"checklist": checklist("dimensions", "reviewed_scores"), "notes": coaching_notes("coaching_narrative", "highlights", "improvement_areas", "note")})
    if redact_text is None:
        return rows

    @F.pandas_udf("array<string>")
    def safe(batch: pd.Series) -> pd.Series:
        return batch.map(lambda texts: [redact_text(t) for t in texts])

    put = lambda c, field, by: F.transform(c, lambda x, i: x.withField(field, by[i]))
    rows = rows.withColumn("_safe", safe(F.concat(F.col("checklist.reason"), F.col("notes.text"))))
    n = F.size("checklist")
    return rows.withColumns({"checklist": put(F.col("checklist"), "reason", F.slice("_safe", F.lit(1), n)), "notes": put(F.col("notes"), "text", F.slice("_safe", n + 1, F.size("notes")))}).drop("_safe")


def findings_export(calls: DataFrame, findings: DataFrame, scope: Scope, start: datetime, end: datetime, redact=lambda c: c, limit: int = MAX_EXPORT_ROWS) -> DataFrame:
    """Findings of the calls' current transcripts as text cells that no spreadsheet runs. The result holds
    up to limit + 1 rows; ``exported`` rejects the extra one."""
    require(scope, "COMPLIANCE_OFFICER")
    seen = scoped(calls, scope).filter(alive()).filter(between("created_at", start, end, MAX_EXPORT_DAYS))
    rows = seen.join(findings, ["call_id", "transcript_revision"]).orderBy("created_at", "call_id", "rule_id").limit(limit + 1)
    cells = {
        "call_id": F.col("call_id").cast("string"),
        "team_id": redact(F.col("team_id")),
        "call_created_at": iso_utc(F.col("created_at").cast("timestamp")),
        "rule_id": redact(F.col("rule_id")),
        "ruleset_version": redact(F.col("ruleset_version")),
        "status": F.col("status"),
        "severity": F.col("severity"),
        "deadline_ms": F.coalesce(F.col("deadline_ms").cast("string"), F.lit("")),
        "remediation": redact(F.col("remediation")),
    }
    return rows.select(*[csv_cell(c).alias(n) for n, c in cells.items()])


def exported(rows: DataFrame, path: str, limit: int = MAX_EXPORT_ROWS) -> int:
    """Writes an export (bounded by limit) as one CSV file with CRLF line ends; more rows are an error."""
    got = rows.limit(limit + 1).toPandas()
    if len(got) > limit:
        raise ValueError("the export has more rows than allowed")
    got.to_csv(path, index=False, lineterminator="\r\n")
    return len(got)


def call_detail(calls: DataFrame, audits: DataFrame, reviews: DataFrame, findings: DataFrame, scope: Scope) -> DataFrame:
    """One row a call: its newest audit with a superseded flag, its findings and its reviews. Only children of
    calls in scope are read on, and they are aggregated by call before they are joined."""
    seen = scoped(calls, scope).filter(alive())
    own = lambda df, *keys: df.join(seen.select(*keys), list(keys), "left_semi")
    newest = F.max_by(F.struct("audit_id", F.col("revision").alias("audit_revision"), F.col("transcript_revision").alias("_audited"), "decision", "overall_score"), F.struct("revision", "audit_id"))
    top = own(audits, "call_id").groupBy("call_id").agg(newest.alias("a")).select("call_id", "a.*")
    notes = reviews.join(top.select("audit_id"), "audit_id", "left_semi").groupBy("audit_id").agg(F.count(F.lit(1)).alias("n_reviews"), F.max("version").alias("current_review_version"))
    found = own(findings, "call_id", "transcript_revision").groupBy("call_id", "transcript_revision").agg(F.array_sort(F.collect_list(F.struct("rule_id", "status", "severity"))).alias("findings"))
    rows = seen.join(top, "call_id", "left").join(notes, "audit_id", "left").join(found, ["call_id", "transcript_revision"], "left")
    return rows.withColumn("superseded", F.coalesce(F.col("_audited") != F.col("transcript_revision"), F.lit(True))).withColumn("current_review_version", F.coalesce("current_review_version", F.lit(0))).drop("_audited")

