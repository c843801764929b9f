"""Disposition rules: a configuration is compiled once on the driver into Catalyst expressions.

Signals of a call are one struct column by question: noul (p_yes, confidence), choice (value,
probabilities, confidence) or score (value, confidence); an absent signal is null. Conditions follow
three-valued logic, which is SQL's: an unknown rule is passed over, and matters only if none matches.
A combinator inside another one is unknown, unless nested="recursive".
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from callgrid.session import written

# fixed limits of a configuration
MAX_BYTES, MAX_VALUES, MAX_DEPTH, MAX_ITEMS, MAX_TEXT = 262_144, 20_000, 16, 4096, 16_384
# fixed values: fields of a configuration and of its identity, names that no field may have, identifiers
FIELDS = ("schema_version", "config_id", "version", "identity", "questions", "taxonomy", "front_gates", "resolver", "confidence", "runtime", "output")
IDENTITY_FIELDS = ("use_case_id", "display_name", "default_locale")
FORBIDDEN = (
    "provider", "model", "adapter", "api_profile", "endpoint", "tenant_id", "organisation_id", "organization_id", "credential", "credentials",
    "token", "password", "secret", "api_key", "apikey", "authorization", "expression", "script",
)
IDENTIFIER, SCHEMA_VERSION = r"[a-zA-Z0-9][a-zA-Z0-9_.-]{1,127}", "1.0.0"
OPERATORS = {"noul": ("EXISTS", "NOUL_GTE", "NOUL_LTE"), "choice": ("EXISTS", "CHOICE_EQ", "CHOICE_IN", "CHOICE_CONFIDENCE_GTE"), "score": ("EXISTS", "SCORE_GTE", "SCORE_LTE")}
GATE_OPERATORS = ("EQ", "NE", "IN", "NOT_IN", "EXISTS")
CONFLICT_SPREAD = 0.25


class ConfigError(ValueError):
    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


@dataclass(frozen=True)
class Config:
    questions: dict
    codes: dict
    gates: list
    rules: list
    default: str
    commit: float
    review: float
    per_code: dict = field(default_factory=dict)
    runtime: dict = field(default_factory=dict)


def head_faults(raw: dict) -> list[str]:
    """What is wrong with a configuration's fields, identity and version."""
    named = lambda x: isinstance(x, str) and re.fullmatch(IDENTIFIER, x) is not None
    who = raw.get("identity", {})
    own = who if isinstance(who, dict) else {}
    shown, locale, version = own.get("display_name", raw.get("config_id")), own.get("default_locale", ""), raw.get("version")
    checks = [
        (isinstance(who, dict), "identity: an object is needed"),
        (named(raw.get("config_id")), "config_id: an identifier is needed"),
        (named(own.get("use_case_id")), "identity.use_case_id: an identifier is needed"),
        (isinstance(shown, str) and 0 < len(shown.strip()) and len(shown) <= 160, "identity.display_name: 1 to 160 characters are needed"),
        (isinstance(locale, str) and len(locale) <= 32, "identity.default_locale: at most 32 characters are allowed"),
        (type(version) is int and 0 < version < 2**31, "version: a positive number of 31 bits is needed"),
        (raw.get("schema_version", SCHEMA_VERSION) == SCHEMA_VERSION, "schema_version: unknown"),
    ]
    unknown = [f"{k}: unknown field" for k in raw if k not in FIELDS] + [f"identity.{k}: unknown field" for k in own if k not in IDENTITY_FIELDS]
    return unknown + [fault for fine, fault in checks if not fine]


def compile_config(raw: dict) -> Config:
    """Checks a configuration, gathering all errors, and orders gates and rules by priority."""
    errors: list[str] = []
    say = errors.append
    try:
        if len(json.dumps(raw, allow_nan=False).encode()) > MAX_BYTES:
            say(f"larger than {MAX_BYTES} bytes")
    except (TypeError, ValueError, RecursionError):
        raise ConfigError(["not plain JSON data"]) from None
    n = 0
    todo = [("$", raw, 0)]
    while todo:
        path, value, depth = todo.pop()
        n += 1
        if depth > MAX_DEPTH:
            say(f"{path}: deeper than {MAX_DEPTH}")
            continue
        children = list(value.items()) if isinstance(value, dict) else list(enumerate(value)) if isinstance(value, list) else []
        if len(children) > MAX_ITEMS:
            say(f"{path}: more than {MAX_ITEMS} items")
            continue
        todo += [(f"{path}.{k}", v, depth + 1) for k, v in children]
        if isinstance(value, dict):
            errors += [f"{path}.{k}: not a field of a configuration" for k in value if not isinstance(k, str) or k.lower() in FORBIDDEN]
        if isinstance(value, str) and len(value) > MAX_TEXT:
            say(f"{path}: longer than {MAX_TEXT} characters")
        if type(value) is int and not -(2**63) <= value < 2**63:
            say(f"{path}: not a number of 64 bits")
        if isinstance(value, str) and any(x in value for x in ("://", "${", "{{")):
            say(f"{path}: links and templates are not allowed")
    if n > MAX_VALUES:
        say(f"more than {MAX_VALUES} values")

    errors += head_faults(raw)
    questions = raw.get("questions") or {}
    if not questions:
        say("questions: none")
    for q, d in questions.items():
        if d.get("type") not in OPERATORS:
            say(f"questions.{q}: unknown type")
    codes = {c.get("code"): c for c in (raw.get("taxonomy") or {}).get("codes", [])}
    if len(codes) != len((raw.get("taxonomy") or {}).get("codes", [])):
        say("taxonomy: codes repeat")
    for code, c in codes.items():
        seen, at = set(), c
        while at and at.get("parent_code"):
            if at["code"] in seen:
                say(f"taxonomy.{code}: parents form a ring")
                break
            seen.add(at["code"])
            up = codes.get(at["parent_code"])
            if up is None or at.get("level", 0) <= up.get("level", 0):
                say(f"taxonomy.{at['code']}: the parent is unknown or not above")
                break
            at = up

    def number(x, path):
        if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or not 0 <= x <= 1:
            say(f"{path}: a number from 0 to 1 is needed")
            return 0.0
        return float(x)

    def check(node, path):
        if not isinstance(node, dict):
            return say(f"{path}: a condition is an object")
        for name in ("all", "any"):
            if name in node:
                for i, x in enumerate(node[name]):
                    check(x, f"{path}.{name}[{i}]")
                return None
        if "not" in node:
            return check(node["not"], f"{path}.not")
        q = questions.get(node.get("signal"))
        if q is None:
            return say(f"{path}: unknown signal")
        op = node.get("operator")
        if op not in OPERATORS.get(q.get("type"), ()):
            return say(f"{path}: {op} does not fit the signal")
        if op.endswith(("_GTE", "_LTE")):
            number(node.get("value"), path)
        return None

    def ordered(items, name):
        if len({x.get("priority") for x in items}) != len(items) or len({x.get("id") for x in items}) != len(items):
            say(f"{name}: ids and priorities must be distinct")
        return sorted(items, key=lambda x: x.get("priority", 0))

    resolver = raw.get("resolver") or {}
    gates, rules = ordered(raw.get("front_gates", []), "front_gates"), ordered(resolver.get("rules", []), "rules")
    for g in gates:
        if g.get("condition", {}).get("operator") not in GATE_OPERATORS:
            say(f"front_gates.{g.get('id')}: unknown operator")
    for r in rules:
        check(r.get("when"), f"rules.{r.get('id')}")
    for x in [*gates, *rules]:
        if x.get("emit") not in codes:
            say(f"{x.get('id')}: emits an unknown code")
    conf = raw.get("confidence") or {}
    per = {k: number(v.get("commit_threshold"), f"confidence.{k}") for k, v in conf.get("per_code", {}).items()}
    out = Config(questions, codes, gates, rules, resolver.get("default_emit", "REVIEW"), number(conf.get("default_commit_threshold"), "commit"), number(conf.get("default_review_threshold"), "review"), per, raw.get("runtime") or {})
    if errors:
        raise ConfigError(errors)
    return out


def _leaf(node: dict, questions: dict) -> Column:
    unknown = F.lit(None).cast("boolean")
    q = node.get("signal")
    if q not in questions:
        return unknown
    s, op, v = F.col(q), node["operator"], node.get("value")
    if op == "EXISTS":
        return F.when(s.isNotNull(), True)
    if op == "CHOICE_EQ":
        return s["value"] == v
    if op == "CHOICE_IN":
        return s["value"].isin(*v) if isinstance(v, list) else unknown
    name = {"NOUL": "p_yes", "CHOICE": "confidence", "SCORE": "value"}[op.split("_")[0]]
    return s[name] >= float(v) if op.endswith("_GTE") else s[name] <= float(v)


def predicate(node: dict, questions: dict, nested: str = "unknown", top: bool = True) -> Column:
    """A condition as an expression that is true, false or null."""
    inner = lambda x: predicate(x, questions, nested, False)
    kind = next((k for k in ("all", "any", "not") if k in node), None)
    if kind and not top and nested != "recursive":
        return F.lit(None).cast("boolean")
    if kind == "not":
        return ~inner(node["not"])
    if kind:
        parts = [inner(x) for x in node[kind]]
        out = F.lit(kind == "all")
        for p in parts:
            out = (out & p) if kind == "all" else (out | p)
        return out
    return _leaf(node, questions)


def _signals_of(node: dict) -> list[str]:
    for k in ("all", "any"):
        if k in node:
            return [s for x in node[k] for s in _signals_of(x)]
    return _signals_of(node["not"]) if "not" in node else [node.get("signal")]


def gate(config: Config) -> Column:
    """The id of the first front gate that matches; facts are columns, and a missing fact never matches."""
    out = None
    for g in config.gates:
        if not g.get("enabled", True):
            continue
        fact, op, v = F.col(g["source"]), g["condition"]["operator"], g["condition"].get("value")
        hit = {"EQ": lambda: fact == v, "NE": lambda: fact != v, "IN": lambda: fact.isin(*v), "NOT_IN": lambda: ~fact.isin(*v), "EXISTS": lambda: fact.isNotNull()}[op]()
        cond = fact.isNotNull() & hit
        out = F.when(cond, g["id"]) if out is None else out.when(cond, g["id"])
    return out if out is not None else F.lit(None).cast("string")


def resolve(rows: DataFrame, config: Config, nested: str = "unknown") -> DataFrame:
    """Adds status, code, confidence, review_reason and matched_rule. Columns: one struct a question, and the
    facts that front gates name."""
    every = [F.col(q) for q in config.questions]
    missing = F.lit(False)
    for s in every:
        missing = missing | s.isNull()
    tests = {r["id"]: predicate(r["when"], config.questions, nested) for r in config.rules}
    first, unsure = F.lit(None).cast("string"), F.lit(False)
    for r in reversed(config.rules):
        first = F.when(tests[r["id"]], r["id"]).otherwise(first)
        unsure = unsure | tests[r["id"]].isNull()
    rows = rows.withColumns({"_gate": gate(config), "_rule": first, "_unsure": unsure, "_missing": missing})
    conf = F.lit(None).cast("double")
    code = F.lit(None).cast("string")
    least = F.lit(config.commit)
    for r in config.rules:
        mine = F.col("_rule") == r["id"]
        used = [F.col(s)["confidence"] for s in dict.fromkeys(_signals_of(r["when"])) if s in config.questions]
        conf = F.when(mine, F.least(*used) if len(used) > 1 else used[0] if used else None).otherwise(conf)
        code = F.when(mine, r["emit"]).otherwise(code)
        least = F.when(mine, max(config.per_code.get(r["emit"], config.commit), config.review)).otherwise(least)
    all_conf = [s["confidence"] for s in every]
    lowest = F.least(*all_conf) if len(all_conf) > 1 else all_conf[0] if all_conf else F.lit(0.0)
    by_default = config.default in config.codes and config.default != "REVIEW"
    rows = rows.withColumns({"_conf": F.when(F.col("_rule").isNotNull(), conf).otherwise(lowest), "_code": F.when(F.col("_rule").isNotNull(), code).otherwise(F.lit(config.default)), "_least": least})
    reason = (
        F.when(F.col("_gate").isNotNull(), None)
        .when(F.col("_missing"), "MISSING_OR_EXTRA_SIGNAL")
        .when(F.col("_rule").isNull() & F.col("_unsure"), "UNCERTAIN_RULE_EVIDENCE")
        .when(F.col("_rule").isNull() & F.lit(not by_default), "NO_RULE_MATCHED")
        .when(F.coalesce(F.col("_conf") < F.col("_least"), F.lit(True)), "LOW_CONFIDENCE")
    )
    gate_code = F.lit(None).cast("string")
    for g in config.gates:
        gate_code = F.when(F.col("_gate") == g["id"], g["emit"]).otherwise(gate_code)
    rows = rows.withColumn("review_reason", reason)
    done = F.col("review_reason").isNull()
    gated = F.col("_gate").isNotNull()
    return (
        rows.withColumn("status", F.when(done, "RESOLVED").otherwise("NEEDS_REVIEW"))
        .withColumn("code", F.when(gated, gate_code).when(done, F.col("_code")))
        .withColumn("confidence", F.when(gated, 1.0).when(done, F.col("_conf")))
        .withColumn("matched_rule", F.when(gated, F.col("_gate")).when(done, F.col("_rule")))
        .drop("_gate", "_rule", "_unsure", "_missing", "_conf", "_code", "_least")
    )


def aggregate_chunks(chunks: DataFrame, kind: str, review: float = 0.45) -> DataFrame:
    """Signals of a call's chunks as one. kind "noul" or "score": call_id, value, confidence; "choice": call_id,
    value, probabilities, confidence. A conflict gives null values."""
    if kind in ("noul", "score"):
        sums = chunks.groupBy("call_id").agg((F.max("value") - F.min("value") > CONFLICT_SPREAD).alias("conflict"), F.avg("value").alias("value"), F.min("confidence").alias("confidence"))
        return sums.withColumn("value", F.when(~F.col("conflict"), F.col("value"))).withColumn("confidence", F.when(~F.col("conflict"), F.col("confidence")))
    by_call = chunks.groupBy("call_id").agg((F.count_distinct(F.when(F.col("confidence") >= review, F.col("value"))) > 1).alias("conflict"), F.min("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))
    each = chunks.select("call_id", F.explode("probabilities").alias("code", "p")).groupBy("call_id", "code").agg(F.sum("p").alias("p"))
    # the highest mean; on a tie the code that sorts first
    best = each.groupBy("call_id").agg(F.min(F.struct((-F.col("p")).alias("p"), F.col("code").alias("code"))).alias("b"))
    rows = by_call.join(best, "call_id")
    return rows.select("call_id", "conflict", F.when(~F.col("conflict"), F.col("b.code")).alias("value"), F.when(~F.col("conflict"), -F.col("b.p") / F.col("n")).alias("probability"), F.when(~F.col("conflict"), F.col("confidence")).alias("confidence"))


def choice_valid(value: Column, probabilities: Column, confidence: Column) -> Column:
    """Probabilities from 0 to 1 that add up to 1, the value among the highest, the confidence its own; all within 0.02."""
    p = F.map_values(probabilities)
    mine = F.try_element_at(probabilities, value)
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.forall(p, lambda x: x.between(0, 1)) & (F.abs(total - 1) <= 0.02) & (mine + 0.02 >= F.array_max(p)) & (F.abs(mine - confidence) <= 0.02), F.lit(False))


def speaker_turns(utterances: DataFrame) -> DataFrame:
    """Neighbouring utterances of one known speaker and role as one turn: call_id, turn, role, speaker,
    start_ms, end_ms, ids, text. An utterance without a speaker stays alone."""
    w = Window.partitionBy("call_id").orderBy("start_ms", "end_ms", "id")
    who = F.nullif(F.col("speaker"), F.lit(""))
    same = who.isNotNull() & (F.lag("role").over(w) == F.col("role")) & (F.lag(who).over(w) == who)
    rows = utterances.withColumn("_new", F.when(same, 0).otherwise(1))
    rows = rows.withColumn("turn", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.struct("start_ms", "end_ms", "id", "text")
    turns = rows.groupBy("call_id", "turn").agg(F.first("role").alias("role"), F.first("speaker").alias("speaker"), F.array_sort(F.collect_list(part)).alias("u"))
    return turns.select("call_id", "turn", "role", "speaker", F.col("u")[0]["start_ms"].alias("start_ms"), F.array_max("u.end_ms").alias("end_ms"), F.col("u.id").alias("ids"), F.array_join("u.text", "\n").alias("text"))


def pack_turns(sizes: list[int], context: int, window: int, overlap: int, most: int) -> list[list[int]] | None:
    """Turn numbers of each window under a budget of characters; None where the call does not fit."""
    total = sum(sizes)
    if total > context or max(sizes, default=0) > window < total:
        return None
    if total <= window:
        return [list(range(len(sizes)))]
    out: list[list[int]] = []
    first, used = 0, 0  # the open window's first turn, and its characters
    for i, size in enumerate(sizes):
        if first < i and used + size > window:
            out.append(list(range(first, i)))
            first = max(first, i - overlap)
            used = sum(sizes[first:i])
            while first < i and used + size > window:
                used -= sizes[first]
                first += 1
        used += size
    out.append(list(range(first, len(sizes))))
    return out if len(out) <= most else None


def turn_windows(turns: DataFrame, context: int = 100_000, window: int = 12_000, overlap: int = 1, most: int = 128) -> DataFrame:
    """call_id, window, turns (their numbers); a call that does not fit has no rows. Only the turns' lengths are
    gathered by call, and packed one call at a time."""
    import pandas as pd

    by_call = turns.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("t")).select("call_id", F.col("t.turn").alias("turns"), F.col("t.n").alias("sizes"))

    def pack(batches):
        for pdf in batches:
            rows = [(c, i, [int(t[j]) for j in w]) for c, t, s in zip(pdf["call_id"], pdf["turns"], pdf["sizes"]) for i, w in enumerate(pack_turns([int(x) for x in s], context, window, overlap, most) or [])]
            yield pd.DataFrame(rows, columns=["call_id", "window", "turns"])

    return by_call.mapInPandas(pack, f"call_id {turns.schema['call_id'].dataType.simpleString()}, window int, turns array<int>")


def abstain_reason(utterances: DataFrame) -> DataFrame:
    """First reason why a call cannot be classified: call_id, reason."""
    sums = utterances.groupBy("call_id").agg(F.min("is_final").alias("final"), F.min(F.coalesce(F.col("role").isin("AGENT", "CUSTOMER"), F.lit(False))).alias("roles"), F.min(F.coalesce(F.length(F.trim("text")) > 0, F.lit(False))).alias("full"))
    return sums.select("call_id", F.when(~F.col("final"), "INCOMPLETE_TRANSCRIPT").when(~F.col("roles"), "UNCERTAIN_SPEAKER_ROLE").when(~F.col("full"), "EMPTY_TRANSCRIPT_TURN").alias("reason"))


SIGNALS = "window int, question string, number double, choice string, probabilities map<string,double>, confidence double"


def signal_row(question: dict, signal: dict, ids: set) -> tuple:
    """(number, choice, probabilities, confidence) of a model's signal; a ValueError, TypeError or KeyError if it
    does not fit its question or names evidence from outside its window."""
    kind, confidence = question["type"], float(signal["confidence"])
    number, choice, shares = None, None, None
    if not 0 <= confidence <= 1 or any(e not in ids for e in signal.get("evidence_ids", [])):
        raise ValueError("confidence or evidence")
    if kind == "choice":
        choice, shares = signal["value"], {str(k): float(p) for k, p in signal["probabilities"].items()}
        options = set(question["criteria"])
        mine = shares[choice]
        if set(shares) != options or not all(0 <= p <= 1 for p in shares.values()) or abs(sum(shares.values()) - 1) > 0.02 or mine + 0.02 < max(shares.values()) or abs(mine - confidence) > 0.02:
            raise ValueError("probabilities")
    else:
        number = float(signal["p_yes" if kind == "noul" else "value"])
        if not (0 <= number <= 1 if kind == "noul" else math.isfinite(number)):
            raise ValueError("value")
    return number, choice, shares, confidence


def asked(texts: DataFrame, questions: dict, adapter) -> DataFrame:
    """What a model says of each window. texts: call_id, window, turn, ids, text. adapter(questions, texts of
    one window's turns) gives {question: signal}; it is called once a window, in a table function that gets
    the windows' turns in order. A row for each question, or one without a question where the answer is not
    valid."""
    from pyspark.sql.functions import udtf

    kind = texts.schema["call_id"].dataType.simpleString()

    @udtf(returnType=f"call_id {kind}, {SIGNALS}")
    class Ask:
        def __init__(self):
            self.key, self.texts, self.ids = None, [], set()

        def eval(self, row):
            self.key = (row["call_id"], row["window"])
            self.texts.append(row["text"])
            self.ids.update(row["ids"])

        def terminate(self):
            if self.key is None:
                return
            try:
                said = adapter(questions, self.texts)
                if set(said) != set(questions):
                    raise ValueError("questions")
                rows = [(*self.key, q, *signal_row(questions[q], said[q], self.ids)) for q in questions]
            except (ValueError, TypeError, KeyError, AttributeError):
                rows = [(*self.key, None, None, None, None, None)]
            yield from rows

    return Ask(texts.asTable().partitionBy("call_id", "window").orderBy("turn"))


def signals_of(said: DataFrame, questions: dict, review: float) -> DataFrame:
    """The signals of each call's windows as one: call_id, a struct a question, n, invalid and conflict."""
    rows = said.groupBy("call_id").agg(F.count_distinct("window").alias("n"), F.max(F.col("question").isNull()).alias("invalid"))
    conflict = F.lit(False)
    for q, question in questions.items():
        part = said.filter(F.col("question") == q)
        if question["type"] == "choice":
            one = part.groupBy("call_id").agg(F.max("choice").alias("_only"))  # of a call with one window
            many = aggregate_chunks(part.select("call_id", F.col("choice").alias("value"), "probabilities", "confidence"), "choice", review)
            each = many.join(one, "call_id").select("call_id", F.col("conflict").alias(f"_conflict_{q}"), F.struct(F.col("value"), F.col("_only"), F.col("confidence")).alias(q))
            rows = rows.join(each, "call_id", "left").withColumn(q, F.when(F.col(q).isNotNull(), F.struct(F.when(F.col("n") == 1, F.col(q)["_only"]).otherwise(F.col(q)["value"]).alias("value"), F.col(q)["confidence"].alias("confidence"))))
        else:
            name = "p_yes" if question["type"] == "noul" else "value"
            each = aggregate_chunks(part.select("call_id", F.col("number").alias("value"), "confidence"), question["type"], review)
            rows = rows.join(each.select("call_id", F.col("conflict").alias(f"_conflict_{q}"), F.struct(F.col("value").alias(name), "confidence").alias(q)), "call_id", "left")
        conflict = conflict | F.coalesce(F.col(f"_conflict_{q}"), F.lit(False))
    return rows.withColumn("conflict", conflict).drop(*[f"_conflict_{q}" for q in questions])


def classify(utterances: DataFrame, config: Config, adapter, facts: DataFrame | None = None) -> DataFrame:
    """The whole classification: front gates on the caller's facts, reasons to abstain, turns, windows, an
    injected model call over each window (see ``asked``), the windows' signals as one, and the rules. facts:
    call_id (once) and the columns that gates name; a call that a gate decides is not shown to the model.
    Gives call_id, status, code, confidence, review_reason and matched_rule of every call of either table."""
    sources = list(dict.fromkeys(g["source"] for g in config.gates))
    calls = utterances.select("call_id").distinct()
    if facts is None:
        known = calls
        for name in sources:
            known = known.withColumn(name, F.lit(None).cast("string"))
    else:
        known = calls.join(facts.select("call_id", *[c if c in facts.columns else F.lit(None).cast("string").alias(c) for c in sources]), "call_id", "full")
    open_ = known.withColumn("_gate", gate(config)).filter("_gate is null").select("call_id")
    reasons = abstain_reason(utterances)
    fit = utterances.join(reasons.filter("reason is null").select("call_id"), "call_id", "left_semi").join(open_, "call_id", "left_semi")
    turns = speaker_turns(fit)
    runtime = config.runtime
    windows = turn_windows(turns, runtime.get("context_limit_chars", 100_000), runtime.get("window_chars", 12_000), runtime.get("overlap_turns", 1), runtime.get("max_chunks", 128))
    texts = windows.select("call_id", "window", F.explode("turns").alias("turn")).join(turns.select("call_id", "turn", F.transform("ids", lambda i: i.cast("string")).alias("ids"), "text"), ["call_id", "turn"])
    # written once, so that no part of the plan asks the model again
    said = signals_of(written(asked(texts, config.questions, adapter)), config.questions, config.review)
    rows = known.join(reasons, "call_id", "left").join(said, "call_id", "left")
    early = F.when(F.col("_spoken").isNull(), "INCOMPLETE_TRANSCRIPT").otherwise(F.coalesce("reason", F.when(F.col("n").isNull(), "CONTEXT_LIMIT").when(F.col("invalid"), "INVALID_MODEL_OUTPUT").when(F.col("conflict"), "CONFLICTING_CHUNK_SIGNALS")))
    rows = rows.join(calls.withColumn("_spoken", F.lit(True)), "call_id", "left").withColumn("early", F.when(gate(config).isNull(), early))
    done = resolve(rows, config)
    kept = lambda c: F.when(F.col("early").isNull(), F.col(c)).alias(c)
    return done.select("call_id", F.when(F.col("early").isNotNull(), "NEEDS_REVIEW").otherwise(F.col("status")).alias("status"), kept("code"), kept("confidence"), F.coalesce("early", "review_reason").alias("review_reason"), kept("matched_rule"))
