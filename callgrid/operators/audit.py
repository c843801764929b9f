"""Rubric scores, audit decisions, evidence and the effect of reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the rubric's dimensions and weights, in order
WEIGHTS = {"greeting": 10, "listening": 15, "resolution": 25, "compliance": 20, "clarity": 10, "objection": 10, "closing": 10}
OPTIONAL, MAX_CONTEXT_CHARS, MAX_QUOTES, MAX_QUOTE_CHARS = "objection", 100_000, 16, 500


def compile_rubric(raw: dict) -> dict:
    """Checks a rubric against the fixed dimensions and weights and adds its hash."""
    import hashlib
    import json

    if set(raw) != {"schema_version", "rubric_version", "pass_threshold", "dimensions"}:
        raise ValueError("a rubric has schema_version, rubric_version, pass_threshold and dimensions")
    if {d.get("id"): d.get("weight") for d in raw["dimensions"]} != WEIGHTS or any(len(d.get("anchors", ())) != 3 for d in raw["dimensions"]):
        raise ValueError("dimensions, weights and three anchors each must be the fixed ones")
    if not 1 <= raw["pass_threshold"] <= 5:
        raise ValueError("the threshold is 1 to 5")
    digest = hashlib.sha256(json.dumps(raw, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    return raw | {"rubric_hash": digest}


def weighted_scores(scores: DataFrame, key: str = "call_id") -> DataFrame:
    """scores: key, dim (1 to 7, in the order of WEIGHTS), score, not_applicable. One row a key; a missing
    score gives null, a dimension that does not apply leaves the mean."""
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS.values()]), F.col("dim"))
    sums = scores.groupBy(key).agg(
        F.sum(F.when(~F.col("not_applicable"), F.col("score") * weight)).alias("s"),
        F.sum(F.when(~F.col("not_applicable"), weight)).alias("w"),
        F.count_if(~F.col("not_applicable") & F.col("score").isNull()).alias("missing"),
    )
    return sums.select(key, F.when(F.col("missing") == 0, F.round(F.try_divide(F.col("s"), F.col("w")), 2)).alias("score"))


def weighted_score(scores: Column) -> Column:
    """The same from a map of dimension to score, with "NOT_APPLICABLE" or null values as texts."""
    s = w = F.lit(0)
    for name, weight in WEIGHTS.items():
        used = ~F.coalesce(F.element_at(scores, F.lit(name)) == "NOT_APPLICABLE", F.lit(False)) if name == OPTIONAL else F.lit(True)
        s = s + F.when(used, F.element_at(scores, F.lit(name)).cast("int") * weight).otherwise(0)
        w = w + F.when(used, weight).otherwise(0)
    return F.round(s / w, 2)


def overridden(current: Column, changed: Column) -> Column:
    """Score maps merged; changes win."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(current), lambda e: ~F.map_contains_key(changed, e["key"])), F.map_entries(changed)))


def unresolved_critical(findings: DataFrame) -> DataFrame:
    """Calls and transcripts with a HIGH finding that is unknown or a potential violation."""
    return findings.filter("severity = 'HIGH' and status in ('UNKNOWN', 'POTENTIAL_VIOLATION')").select("call_id", "transcript_revision").distinct()


def decided(scored: DataFrame, findings: DataFrame, threshold: float) -> DataFrame:
    """Adds decision and review_reason to rows of (call_id, transcript_revision, score)."""
    rows = scored.join(unresolved_critical(findings).withColumn("critical", F.lit(True)), ["call_id", "transcript_revision"], "left").withColumn("critical", F.coalesce("critical", F.lit(False)))
    reason = F.when(F.col("critical"), "UNRESOLVED_CRITICAL_FINDING").when(F.col("score").isNull(), "INSUFFICIENT_EVIDENCE")
    return rows.withColumn("review_reason", reason).withColumn("decision", F.when(F.col("review_reason").isNotNull(), "NEEDS_REVIEW").when(F.col("score") >= threshold, "PASS").otherwise("FAIL")).drop("critical")


def preconditions(calls: DataFrame, utterances: DataFrame, findings: DataFrame) -> DataFrame:
    """First reason, if any, why a call cannot be audited: call_id, reason."""
    spoken = utterances.groupBy("call_id").agg(F.min("is_final").alias("final"), F.sum(F.length("text")).alias("chars"))
    sourced = findings.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce(F.col("ruleset_version").rlike("^.{1,64}$") & F.col("ruleset_hash").rlike("^[0-9a-f]{64}$"), F.lit(False))).alias("sourced"))
    rows = calls.select("call_id").join(spoken, "call_id", "left").join(sourced, "call_id", "left")
    reason = (
        F.when(F.col("final").isNull() | ~F.col("final"), "INCOMPLETE_TRANSCRIPT")
        .when(F.col("chars") > MAX_CONTEXT_CHARS, "CONTEXT_LIMIT")
        .when(F.col("n").isNotNull() & ~F.col("sourced"), "POLICY_PROVENANCE_MISSING")
        .when(F.col("n").isNull(), "POLICY_STAGE_INCOMPLETE")
    )
    return rows.select("call_id", reason.alias("reason"))


def checked_quotes(quotes: DataFrame, utterances: DataFrame, roles: tuple[str, ...] = ("AGENT",)) -> DataFrame:
    """quotes: call_id, utterance_id, quote. Adds valid, and role and times of the utterance where it is."""
    source = utterances.filter("is_final").select("call_id", F.col("id").alias("utterance_id"), "role", "start_ms", "end_ms", "text")
    rows = quotes.join(source, ["call_id", "utterance_id"], "left")
    fine = F.col("role").isin(*roles) & (F.length(F.trim("quote")) > 0) & (F.length("quote") <= MAX_QUOTE_CHARS) & (F.instr(F.col("text"), F.col("quote")) > 0)
    rows = rows.withColumn("valid", F.coalesce(fine, F.lit(False)))
    return rows.select("call_id", "utterance_id", "quote", "valid", *[F.when(F.col("valid"), F.col(c)).alias(c) for c in ("role", "start_ms", "end_ms")])


def provenance(findings: DataFrame) -> DataFrame:
    """Distinct rule set versions and hashes of a call, in order, and a hash over them."""
    pairs = findings.groupBy("call_id").agg(F.array_sort(F.collect_set(F.struct(F.col("ruleset_version").alias("version"), F.col("ruleset_hash").alias("hash")))).alias("sources"))
    item = lambda p: F.concat(F.lit('{"hash":"'), p["hash"], F.lit('","version":"'), p["version"], F.lit('"}'))
    return pairs.withColumn("fingerprint", F.sha2(F.concat(F.lit("["), F.array_join(F.transform("sources", item), ","), F.lit("]")), 256))


def review_effects(requests: DataFrame, threshold: Column) -> DataFrame:
    """requests: action, machine_decision, machine_score, machine_scores, head_action, head_score, head_decision,
    head_scores, changed_scores, critical. Adds error, effective_scores, effective_score and effective_decision."""
    headed = F.col("head_action").isNotNull()
    vector = F.when(headed, F.col("head_scores")).otherwise(F.col("machine_scores"))
    act = F.col("action")
    unfit = F.exists(F.map_keys("changed_scores"), lambda k: F.coalesce(F.try_element_at(vector, k), F.lit("NOT_APPLICABLE")) == "NOT_APPLICABLE")
    merged = overridden(vector, F.col("changed_scores"))
    score = weighted_score(merged)
    error = (
        F.when((act == "TRIAGE") & (F.col("machine_decision") != "NEEDS_REVIEW"), "TRIAGE_NOT_NEEDED")
        .when((act == "TRIAGE") & (F.col("head_action") == "TRIAGE"), "ALREADY_TRIAGED")
        .when((act == "ACCEPT") & ((~headed & F.col("machine_score").isNull()) | (F.col("machine_decision") == "NEEDS_REVIEW")), "INCOMPLETE_AUDIT")
        .when((act == "OVERRIDE") & (F.col("machine_score").isNull() | (F.col("machine_decision") == "NEEDS_REVIEW")), "INCOMPLETE_AUDIT")
        .when((act == "OVERRIDE") & unfit, "UNSCORED_DIMENSION")
        .when((act == "OVERRIDE") & score.isNull(), "INCOMPLETE_SCORES")
    )
    rows = requests.withColumn("error", error)
    ok = F.col("error").isNull()
    return (
        rows.withColumn("effective_scores", F.when(ok & (act == "ACCEPT"), vector).when(ok & (act == "OVERRIDE"), merged))
        .withColumn("effective_score", F.when(ok & (act == "ACCEPT"), F.when(headed, F.col("head_score")).otherwise(F.col("machine_score"))).when(ok & (act == "OVERRIDE"), score))
        .withColumn(
            "effective_decision",
            F.when(ok & (act == "TRIAGE"), "NEEDS_REVIEW")
            .when(ok & (act == "ACCEPT"), F.when(headed, F.col("head_decision")).otherwise(F.col("machine_decision")))
            .when(ok & (act == "OVERRIDE"), F.when(F.col("critical"), "NEEDS_REVIEW").when(F.col("effective_score") >= threshold, "PASS").otherwise("FAIL")),
        )
    )
