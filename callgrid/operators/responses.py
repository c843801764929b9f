"""Answers of models at the boundary: sentiment classes and audit responses, checked before anything uses them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrid.session import written
from callgrid.operators.audit import MAX_QUOTE_CHARS, MAX_QUOTES, OPTIONAL, WEIGHTS, weighted_score

# fixed values: the labels that count as positive and negative, and bounds of a response
POSITIVE, NEGATIVE = ("positive", "pos", "label_2"), ("negative", "neg", "label_0")
MAX_REASON, MAX_NARRATIVE, MAX_NOTES, MAX_ATTEMPTS = 1500, 2000, 8, 3

_QUOTES = "array<struct<utterance_id:string,quote:string>>"
_NOTE = f"struct<text:string,evidence:{_QUOTES}>"
RESPONSE = f"dimensions array<struct<id:string,status:string,score:int,reason:string,evidence:{_QUOTES}>>, coaching_narrative {_NOTE}, highlights array<{_NOTE}>, improvement_areas array<{_NOTE}>"


def classified(texts: Column, classify: Callable[[str], list[dict]]) -> Column:
    """Class scores of texts by a local model: an array of (label, score), null for null."""

    @F.pandas_udf("array<struct<label:string,score:double>>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else [{"label": c["label"], "score": float(c["score"])} for c in classify(t)])

    return run(texts)


def class_signal(classes: Column) -> Column:
    """score (positive less negative, within -1 and 1) and prob (of the likeliest class) of an array of
    (label, score); null unless labels are distinct texts and scores are probabilities that add up to 1
    within 0.02."""
    labels = F.transform(classes, lambda c: F.lower(F.trim(c["label"])))
    total = F.aggregate(classes, F.lit(0.0), lambda a, c: a + c["score"])
    part = lambda of: F.aggregate(F.filter(classes, lambda c: F.lower(F.trim(c["label"])).isin(*of)), F.lit(0.0), lambda a, c: a + c["score"])
    fine = (F.size(classes) > 0) & F.forall(classes, lambda c: F.coalesce((c["label"] != "") & c["score"].between(0, 1), F.lit(False))) & (F.size(F.array_distinct(labels)) == F.size(labels)) & (F.abs(total - 1) <= 0.02)
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), part(POSITIVE) - part(NEGATIVE)))
    return F.when(F.coalesce(fine, F.lit(False)), F.struct(score.alias("score"), F.array_max(F.transform(classes, lambda c: c["score"])).alias("prob")))


def _first(items: Column, fault: Callable[[Column], Column]) -> Column:
    """The fault of the first item that has one."""
    return F.try_element_at(F.filter(F.transform(items, fault), lambda f: f.isNotNull()), F.lit(1))


def _evidence_fault(evidence: Column, spoken: Column) -> Column:
    """spoken: a map of an agent's final utterances, identifier to text."""
    good = lambda q: F.coalesce((F.length(F.trim(q["quote"])) > 0) & (F.length(q["quote"]) <= MAX_QUOTE_CHARS) & F.contains(F.try_element_at(spoken, q["utterance_id"]), q["quote"]), F.lit(False))
    return F.when(evidence.isNull() | (F.size(evidence) > MAX_QUOTES) | ~F.forall(evidence, good), "INVALID_EVIDENCE")


def spoken_by_call(utterances: DataFrame) -> DataFrame:
    """The final utterances of each call's agents: call_id, _spoken (identifier to text), and _twice: whether an
    identifier is there more than once."""
    each = utterances.filter("is_final and role = 'AGENT'").groupBy("call_id", F.col("id").cast("string").alias("id")).agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("n"))
    return each.groupBy("call_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "text"))).alias("_spoken"), (F.max("n") > 1).alias("_twice"))


def checked_responses(responses: DataFrame, utterances: DataFrame) -> DataFrame:
    """responses: call_id, response (JSON) and objection_absent. Adds fault, null for a valid response, and
    overall_score. Faults are looked for in the order of the response: its fields, each dimension, the
    narrative, the notes. A quote must stand in a final utterance of an agent of the same call. Where such an
    identifier is there twice, no quote can be traced: REPEATED_UTTERANCE, before all others."""
    return _checked(responses, spoken_by_call(utterances))


def _checked(responses: DataFrame, own: DataFrame) -> DataFrame:
    rows = responses.join(own, "call_id", "left").withColumn("_agent", F.col("_spoken").isNotNull())
    rows = rows.withColumn("_spoken", F.coalesce("_spoken", F.create_map().cast("map<string,string>")))
    rows = rows.withColumns({"_r": F.from_json("response", RESPONSE), "_keys": F.array_sort(F.json_object_keys("response"))})
    spoken, dims = F.col("_spoken"), F.col("_r.dimensions")
    ids = F.transform(dims, lambda d: d["id"])

    def dimension(d: Column, i: Column) -> Column:
        repeated = F.array_contains(F.slice(ids, F.lit(1), i), d["id"])
        evidence = F.coalesce(F.size(d["evidence"]), F.lit(0))
        return (
            F.when(~F.coalesce(d["id"].isin(*WEIGHTS), F.lit(False)) | repeated, "INVALID_DIMENSION_ID")
            .when(~F.coalesce((F.length(F.trim(d["reason"])) > 0) & (F.length(d["reason"]) <= MAX_REASON), F.lit(False)), "INVALID_REASON")
            .when(_evidence_fault(d["evidence"], spoken).isNotNull(), "INVALID_EVIDENCE")
            .when((d["status"] == "SCORED") & ~F.coalesce(d["score"].between(1, 5) & (evidence > 0), F.lit(False)), "SCORE_REQUIRES_EVIDENCE")
            .when((d["status"] == "INSUFFICIENT_EVIDENCE") & (d["score"].isNotNull() | (evidence > 0)), "INVALID_INSUFFICIENT_EVIDENCE")
            .when((d["status"] == "NOT_APPLICABLE") & ((d["id"] != OPTIONAL) | d["score"].isNotNull() | (evidence > 0) | ~F.coalesce("objection_absent", F.lit(False))), "UNVERIFIED_NOT_APPLICABLE")
            .when(~F.coalesce(d["status"].isin("SCORED", "INSUFFICIENT_EVIDENCE", "NOT_APPLICABLE"), F.lit(False)), "INVALID_DIMENSION_STATUS")
        )

    def note(n: Column, needed: Column) -> Column:
        bad = n.isNull() | n["text"].isNull() | (F.length(n["text"]) > MAX_NARRATIVE) | (needed & (F.length(F.trim(n["text"])) == 0))
        return F.when(bad, "INVALID_NARRATIVE").when(_evidence_fault(n["evidence"], spoken).isNotNull(), "INVALID_EVIDENCE").when(needed & (F.size(n["evidence"]) == 0), "NARRATIVE_REQUIRES_EVIDENCE")

    def notes(c: Column) -> Column:
        return F.when(c.isNull() | (F.size(c) > MAX_NOTES), "INVALID_NARRATIVE_LIST").otherwise(_first(c, lambda n: note(n, F.lit(True))))

    narrative = F.col("_r.coaching_narrative")
    indexed = F.transform(dims, lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    fault = F.coalesce(
        F.when(F.col("_twice"), "REPEATED_UTTERANCE"),
        F.when(F.col("_keys").isNull() | (F.col("_keys") != F.array(*map(F.lit, ("coaching_narrative", "dimensions", "highlights", "improvement_areas")))), "INVALID_SCHEMA"),
        F.when(dims.isNull() | (F.size(dims) != len(WEIGHTS)), "INVALID_DIMENSIONS"),
        _first(indexed, lambda x: dimension(x["d"], x["i"])),
        note(narrative, F.col("_agent")),
        F.when(~F.col("_agent") & (F.length(F.trim(narrative["text"])) > 0), "NARRATIVE_WITHOUT_AGENT_EVIDENCE"),
        notes(F.col("_r.highlights")),
        notes(F.col("_r.improvement_areas")),
    )
    rows = rows.withColumn("fault", fault)
    scores = F.map_from_entries(F.transform(dims, lambda d: F.struct(d["id"], F.when(d["status"] == "NOT_APPLICABLE", "NOT_APPLICABLE").otherwise(d["score"].cast("string")))))
    return rows.withColumn("overall_score", F.when(F.col("fault").isNull(), weighted_score(scores))).drop("_r", "_keys", "_spoken", "_agent", "_twice")


def audited(payloads: DataFrame, utterances: DataFrame, evaluate: Callable[[str, str | None], str | None]) -> DataFrame:
    """payloads: call_id, payload (JSON) and objection_absent. Asks a local model, `evaluate(payload, fault)`, at most
    MAX_ATTEMPTS times a call: an answer with a fault gets one repair, with the fault told; no answer (null)
    is asked for again. Utterances are grouped once, and each attempt's answers are written down, so that a lost
    task's answers are not asked for again. Adds response, fault (INVALID_MODEL_OUTPUT, LOCAL_INFERENCE_UNAVAILABLE or null),
    attempts and overall_score."""

    @F.pandas_udf("string")
    def ask(batch: pd.Series, faults: pd.Series, settled: pd.Series) -> pd.Series:
        return pd.Series([None if s else evaluate(p, f) for p, f, s in zip(batch, faults, settled)], dtype=object)

    own = written(spoken_by_call(utterances))
    open_ = payloads.select("call_id", "payload", "objection_absent", F.lit(None).cast("string").alias("told"), F.lit(0).alias("attempts"))
    for _ in range(MAX_ATTEMPTS):
        # rows that are settled keep their answer; the others are asked once more
        settled = F.col("settled") if "settled" in open_.columns else F.lit(False)
        before = F.col("response") if "response" in open_.columns else F.lit(None).cast("string")
        asked = open_.withColumns({"settled": settled, "response": F.when(settled, before).otherwise(ask("payload", "told", settled)), "attempts": F.col("attempts") + (~settled).cast("int")})
        checked = _checked(written(asked.drop("fault", "overall_score")), own)
        repaired = F.col("told").isNotNull() & F.col("response").isNotNull() & F.col("fault").isNotNull()
        valid = F.col("response").isNotNull() & F.col("fault").isNull()
        open_ = checked.withColumns({"settled": F.col("settled") | valid | repaired, "told": F.when(F.col("response").isNotNull() & F.col("fault").isNotNull(), F.col("fault")).otherwise(F.col("told"))})
    outcome = F.when(F.col("response").isNull(), "LOCAL_INFERENCE_UNAVAILABLE").when(F.col("fault").isNotNull(), "INVALID_MODEL_OUTPUT")
    return open_.select("call_id", "response", outcome.alias("fault"), "attempts", "overall_score")
