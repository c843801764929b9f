"""Files: evaluation cases as JSON lines, pinned JSON settings, CSV reports and event frames."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: ceilings of an evaluation file (bytes, bytes of a line, cases), of a pinned file's bytes and
# of a case; identifiers, statuses and the fields of a case
MAX_BYTES, MAX_LINE_BYTES, MAX_CASES, MAX_PINNED, MAX_FINDINGS, MAX_DIMENSIONS = 16 << 20, 64 << 10, 10_000, 64 << 10, 256, 32
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}\z"
STATUSES = ("PENDING", "SATISFIED", "POTENTIAL_VIOLATION", "UNKNOWN", "ADVISORY")
FIELDS = ("abstained", "case_id", "excluded", "gold_dimensions", "gold_findings", "predicted_dimensions", "predicted_findings")
CASE = "case_id string, excluded boolean, abstained boolean, gold_findings array<struct<rule_id:string,critical:boolean>>, predicted_findings array<struct<rule_id:string,status:string>>, gold_dimensions map<string,double>, predicted_dimensions map<string,double>"


class SourceError(ValueError):
    pass


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON-lines file, blank lines left out; a line that does not parse or is too long fails the
    read, as does a file that is too large or has too many cases. raw has the line as it stands."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    if size is not None and size > MAX_BYTES:
        raise SourceError("the file is too large")
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    if lines.limit(MAX_CASES + 1).count() > MAX_CASES:
        raise SourceError("the file has too many cases")
    bad = F.raise_error(F.lit("a line of the file is too long or is no JSON object"))
    fine = F.when((F.octet_length("value") <= MAX_LINE_BYTES) & F.json_object_keys("value").isNotNull(), F.col("value")).otherwise(bad)
    return parsed_cases(lines.select(fine.alias("raw")))


def parsed_cases(lines: DataFrame) -> DataFrame:
    """lines: raw. The fields of a case, null where they have another type, and raw."""
    # as rows of a generator, so that a line is parsed once and not for every use of a field
    return lines.select(F.inline(F.array(F.from_json("raw", CASE, {"mode": "PERMISSIVE"}))), "raw")


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of one file's bytes."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def case_faults(cases: DataFrame) -> DataFrame:
    """case_id, fault: the first thing that is wrong with each case; none for a valid file. Values of
    another type than theirs read as null and are faults of their field. With a column raw, fields that a
    case or a finding must not have, or lacks, are faults too."""
    names = lambda m: F.forall(F.map_keys(m), lambda k: k.rlike(IDENTIFIER))
    score_ok = lambda m: F.forall(F.map_values(m), lambda x: F.coalesce(~F.isnan(x) & x.between(1, 5), F.lit(False)))
    false_if_null = lambda c: F.coalesce(c, F.lit(False))
    rules = lambda c: F.transform(c, lambda f: f["rule_id"])
    rules_ok = lambda c: F.forall(rules(c), lambda r: F.coalesce(r.rlike(IDENTIFIER), F.lit(False))) & (F.size(F.array_distinct(rules(c))) == F.size(c))
    gold, predicted = F.col("gold_findings"), F.col("predicted_findings")
    fields = F.lit(False)
    if "raw" in cases.columns:
        keys = F.array_sort(F.json_object_keys("raw"))
        item = lambda name, want: F.forall(F.coalesce(F.from_json(F.get_json_object("raw", f"$.{name}"), "array<string>"), F.array().cast("array<string>")), lambda x: F.coalesce(F.array_sort(F.json_object_keys(x)) == F.array(*map(F.lit, want)), F.lit(False)))
        fields = ~false_if_null((keys == F.array(*map(F.lit, FIELDS))) & item("gold_findings", ("critical", "rule_id")) & item("predicted_findings", ("rule_id", "status")))
    fault = (
        F.when(fields, "fields")
        .when(~false_if_null(F.col("case_id").startswith("case-") & F.col("case_id").rlike(IDENTIFIER)), "identifier")
        .when(F.col("excluded").isNull() | F.col("abstained").isNull() | (F.col("excluded") & F.col("abstained")), "flags")
        .when(~false_if_null((F.size(gold) <= MAX_FINDINGS) & (F.size(predicted) <= MAX_FINDINGS)), "findings")
        .when(~false_if_null(rules_ok(gold) & rules_ok(predicted)), "rules")
        .when(~false_if_null(F.forall(gold, lambda f: f["critical"].isNotNull()) & F.forall(predicted, lambda f: F.coalesce(f["status"].isin(*STATUSES), F.lit(False)))), "labels")
        .when(~false_if_null((F.size("gold_dimensions") <= MAX_DIMENSIONS) & (F.size("predicted_dimensions") <= MAX_DIMENSIONS) & names("gold_dimensions") & names("predicted_dimensions")), "dimensions")
        .when(~false_if_null(score_ok("gold_dimensions") & score_ok("predicted_dimensions")), "scores")
    )
    # a filter on the fault would have it worked out twice
    own = cases.select("case_id", F.explode(F.array_compact(F.array(fault))).alias("fault"))
    twice = cases.groupBy("case_id").count().filter("count > 1").select("case_id", F.lit("repeated").alias("fault"))
    return own.unionByName(twice)


def write_report(report: DataFrame, path: str) -> None:
    """A report of one row as a JSON file with sorted keys, two spaces of indent and a line end."""
    rows = report.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise SourceError("a report has one row")
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.write(json.dumps(json.loads(rows[0]), ensure_ascii=False, sort_keys=True, indent=2) + "\n")


def pinned_json(path: str, sha256: str) -> dict:
    """A small settings file whose digest must be the one asked for."""
    with open(path, "rb") as f:
        raw = f.read(MAX_PINNED + 1)
    if len(raw) > MAX_PINNED:
        raise SourceError("the file is too large")
    if hashlib.sha256(raw).hexdigest() != sha256:
        raise SourceError("the file's digest differs")
    return json.loads(raw)


def event_frame(sequence: Column, kind: Column, payload: Column) -> Column:
    """A server-sent event: id, event and compact JSON data."""
    return F.format_string("id: %d\nevent: %s\ndata: %s\n\n", sequence, kind, F.to_json(payload))
