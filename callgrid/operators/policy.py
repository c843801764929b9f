"""Policy checks over timed utterances: opening disclosure, closing phrase, sensitive numbers.

Utterances: call_id, id, role, start_ms, end_ms, text, is_final, in the order (start_ms, id).
Contexts, one row a call: call_id, duration_ms, connected_ms, complete, timing_reliable and holds, an array
of (tag, start_ms, end_ms).
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from callgrid.functions.text import has_sensitive_number, id_fingerprint, normalised_phrase, short_id
from callgrid.operators.intervals import merged_array, overlap, paused_deadline

MAX_HOLDS = 10_000
STATES = ("SATISFIED", "POTENTIAL_VIOLATION", "PENDING", "UNKNOWN")


class RulesetError(ValueError):
    """A rule set that cannot be used."""


def compile_ruleset(raw: dict) -> dict:
    """Checks a rule set and gives its rules with version and hash."""
    kinds = {"OPENING_DISCLOSURE": "opportunity_ms", "CLOSING_PHRASE": "window_ms", "SENSITIVE_NUMBER_ADVISORY": None}
    if set(raw) != {"schema_version", "ruleset_id", "version", "policy_text_version", "rules"}:
        raise RulesetError("a rule set has schema_version, ruleset_id, version, policy_text_version and rules")
    rules, seen = raw["rules"], set()
    if not isinstance(rules, list) or not 1 <= len(rules) <= 100:
        raise RulesetError("1 to 100 rules are needed")
    out = []
    for rule in rules:
        kind = rule.get("type")
        if kind not in kinds:
            raise RulesetError(f"unknown rule type {kind!r}")
        span = kinds[kind]
        want = {"id", "type", "call_types", "severity", "remediation"} | ({span, "phrase_variants"} if span else set())
        if set(rule) != want:
            raise RulesetError(f"{kind} needs the fields {sorted(want)}")
        if not isinstance(rule["id"], str) or rule["id"] in seen:
            raise RulesetError("rule ids must be distinct texts")
        seen.add(rule["id"])
        if rule["severity"] not in ("HIGH", "MEDIUM", "LOW"):
            raise RulesetError("severity is HIGH, MEDIUM or LOW")
        if not rule["call_types"] or not all(isinstance(x, str) and x for x in rule["call_types"]):
            raise RulesetError("call_types lists texts")
        if span and (isinstance(rule[span], bool) or not isinstance(rule[span], int) or not 0 < rule[span] <= 7_200_000):
            raise RulesetError(f"{span} is a positive number of milliseconds")
        if span and not (rule["phrase_variants"] and all(isinstance(x, str) and x.strip() for x in rule["phrase_variants"])):
            raise RulesetError("phrase_variants lists texts")
        out.append(dict(rule, policy_text_version=raw["policy_text_version"]))
    canonical = json.dumps(raw, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return {"ruleset_version": f"{raw['ruleset_id']}:{raw['version']}", "ruleset_hash": hashlib.sha256(canonical.encode()).hexdigest(), "rules": out}


def with_reliability(contexts: DataFrame) -> DataFrame:
    """Adds merged holds (empty where invalid) and `reliable`."""
    d, c = F.col("duration_ms"), F.col("connected_ms")
    holds_fit = F.forall("holds", lambda h: h["tag"].isin("HOLD", "IVR") & (h["start_ms"] >= 0) & (h["start_ms"] <= h["end_ms"]) & (h["end_ms"] <= d))
    holds_fit = F.coalesce(F.col("holds").isNotNull() & (F.size("holds") <= MAX_HOLDS) & holds_fit, F.lit(False))
    fine = d.between(0, 2**31 - 1) & (c >= 0) & (c <= d) & F.col("complete") & F.col("timing_reliable") & holds_fit
    empty = F.array().cast("array<struct<start_ms:bigint,end_ms:bigint>>")
    return contexts.withColumn("reliable", F.coalesce(fine, F.lit(False))).withColumn("held", F.when(holds_fit, merged_array(F.col("holds"))).otherwise(empty))


def phrase_runs(rows: DataFrame, phrases: list[str]) -> DataFrame:
    """The first run of eligible final agent utterances that holds a phrase, by call: call_id, evidence.

    The text of a run is normalised as a whole; each utterance's place in it counts its own normalised
    length and one space, also for an utterance that normalises to nothing."""
    wanted = list(dict.fromkeys(p for p in phrases if p))
    w = Window.partitionBy("call_id").orderBy("start_ms", "id")
    marked = rows.withColumn("_in", F.col("is_final") & (F.col("role") == "AGENT") & F.col("eligible"))
    marked = marked.withColumn("_run", F.sum(F.when(F.col("_in"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.struct("start_ms", "id", F.col("text").alias("t"))
    runs = marked.filter("_in").groupBy("call_id", "_run").agg(F.array_sort(F.collect_list(part)).alias("u"))
    runs = runs.withColumn("_text", normalised_phrase(F.array_join(F.transform("u", lambda x: x["t"]), " ")))
    hit = F.coalesce(*[F.when(F.instr("_text", p) > 0, F.struct((F.instr("_text", p) - 1).alias("at"), F.lit(len(p)).alias("n"))) for p in wanted])
    runs = runs.withColumn("_hit", hit).filter("_hit is not null")
    lengths = F.transform("u", lambda x: F.struct(x["id"].alias("id"), F.length(normalised_phrase(x["t"])).alias("n")))
    start = F.struct(F.lit(0).alias("offset"), F.array().cast("array<string>").alias("ids"))

    def place(acc: Column, x: Column) -> Column:
        end = acc["offset"] + x["n"]
        meets = (x["n"] > 0) & (end > F.col("_hit")["at"]) & (acc["offset"] < F.col("_hit")["at"] + F.col("_hit")["n"])
        return F.struct((end + 1).alias("offset"), F.when(meets, F.concat(acc["ids"], F.array(x["id"].cast("string")))).otherwise(acc["ids"]).alias("ids"))

    runs = runs.withColumn("evidence", F.aggregate(lengths, start, place, lambda acc: acc["ids"]))
    return runs.groupBy("call_id").agg(F.min_by("evidence", "_run").alias("evidence"))


def _windowed(utterances: DataFrame, contexts: DataFrame) -> DataFrame:
    """Utterances with their call's window [w0, w1]: eligible, and unknown speech in time not held."""
    rows = utterances.join(contexts.select("call_id", "w0", "w1", "held"), "call_id")
    inside = (F.col("w0") <= F.col("start_ms")) & (F.col("start_ms") <= F.col("end_ms")) & (F.col("end_ms") <= F.col("w1"))
    free = overlap(F.col("held"), F.col("start_ms"), F.col("end_ms")) == 0
    lo, hi = F.greatest("start_ms", "w0"), F.least("end_ms", "w1")
    unknown = (F.col("role") == "UNKNOWN") & (hi > lo) & (overlap(F.col("held"), lo, hi) < hi - lo)
    return rows.withColumn("eligible", F.coalesce(inside & free, F.lit(False))).withColumn("unheld_unknown", F.coalesce(unknown, F.lit(False)))


def _state_inputs(utterances: DataFrame, contexts: DataFrame, phrases: list[str]) -> DataFrame:
    rows = _windowed(utterances, contexts)
    by_call = rows.groupBy("call_id").agg(
        F.max("unheld_unknown").alias("unknown_speech"), F.max(~F.col("is_final")).alias("partial"), F.max(F.col("eligible") & (F.col("role") == "UNKNOWN")).alias("unknown_eligible")
    )
    out = contexts.join(by_call, "call_id", "left").join(phrase_runs(rows, phrases), "call_id", "left")
    for c in ("unknown_speech", "partial", "unknown_eligible"):
        out = out.withColumn(c, F.coalesce(c, F.lit(False)))
    return out


def opening_disclosure(utterances: DataFrame, contexts: DataFrame, rule: dict) -> DataFrame:
    """call_id, status, evidence_ids, evidence_fingerprint, deadline_ms."""
    c = with_reliability(contexts).withColumn("deadline_ms", paused_deadline(F.col("connected_ms"), F.lit(rule["opportunity_ms"]), F.col("held")))
    c = c.withColumn("w0", F.col("connected_ms")).withColumn("w1", F.least("duration_ms", "deadline_ms"))
    c = c.withColumn("elapsed", F.greatest(F.lit(0).cast("long"), F.col("w1") - F.col("w0") - overlap(F.col("held"), F.col("w0"), F.col("w1"))))
    rows = _state_inputs(utterances, c, _normal(rule["phrase_variants"]))
    sure = F.col("reliable") & ~F.col("partial") & ~F.col("unknown_speech") & ~F.col("unknown_eligible")
    status = F.when(~sure, "UNKNOWN").when(F.col("evidence").isNotNull(), "SATISFIED").when(F.col("elapsed") >= rule["opportunity_ms"], "POTENTIAL_VIOLATION").when(F.coalesce("complete", F.lit(False)), "UNKNOWN").otherwise("PENDING")
    return _findings(rows.withColumn("status", status))


def closing_phrase(utterances: DataFrame, contexts: DataFrame, rule: dict) -> DataFrame:
    """As ``opening_disclosure``; the deadline is the start of the closing window."""
    c = with_reliability(contexts)
    c = c.withColumn("w1", F.col("duration_ms")).withColumn("w0", F.greatest(F.lit(0).cast("long"), F.col("duration_ms") - rule["window_ms"])).withColumn("deadline_ms", F.col("w0"))
    rows = _state_inputs(utterances, c, _normal(rule["phrase_variants"]))
    sure = F.col("reliable") & ~F.col("partial") & ~F.col("unknown_speech")
    return _findings(rows.withColumn("status", F.when(~sure, "UNKNOWN").when(F.col("evidence").isNotNull(), "SATISFIED").otherwise("POTENTIAL_VIOLATION")))


def _normal(phrases: list[str]) -> list[str]:
    import re

    return [" ".join(re.sub(r"[^\w\s]", " ", p.lower()).split()) for p in phrases]


def _findings(rows: DataFrame) -> DataFrame:
    evidence = F.when(F.col("status") == "SATISFIED", F.col("evidence")).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("evidence_ids", F.array_sort(F.array_distinct(evidence)))
    return rows.select("call_id", "status", "evidence_ids", id_fingerprint(F.col("evidence_ids")).alias("evidence_fingerprint"), F.col("deadline_ms").cast("long"))


def findings(utterances: DataFrame, contexts: DataFrame, ruleset: dict) -> DataFrame:
    """Findings of all phrase rules of a compiled rule set that apply to each call's type."""
    check = {"OPENING_DISCLOSURE": opening_disclosure, "CLOSING_PHRASE": closing_phrase}
    out = None
    for rule in ruleset["rules"]:
        if rule["type"] not in check:
            continue
        mine = contexts if "*" in rule["call_types"] else contexts.filter(F.col("call_type").isin(*rule["call_types"]))
        rows = check[rule["type"]](utterances, mine, rule)
        labels = {k: rule[k] for k in ("policy_text_version", "severity", "remediation")} | {"rule_id": rule["id"], "ruleset_version": ruleset["ruleset_version"], "ruleset_hash": ruleset["ruleset_hash"]}
        rows = rows.select("*", *[F.lit(v).alias(k) for k, v in labels.items()])
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise RulesetError("no phrase rule")
    return out


def sensitive_numbers(segments: DataFrame) -> DataFrame:
    """Segments that seem to hold a phone or account number: segment_id, evidence_id. No text is passed on."""
    return segments.filter(has_sensitive_number(F.col("text"))).select("segment_id", short_id(F.col("segment_id").cast("string")).alias("evidence_id"))


def missing_evidence(findings_: DataFrame, utterances: DataFrame) -> DataFrame:
    """Evidence identifiers of findings that the call's transcript does not hold."""
    refs = findings_.select("call_id", F.explode("evidence_ids").alias("id"))
    return refs.join(utterances.select("call_id", F.col("id").cast("string").alias("id")), ["call_id", "id"], "left_anti")
