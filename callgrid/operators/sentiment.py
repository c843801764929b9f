"""Sentiment drops, cooldown and speech trends, in exact arithmetic.

Signals: call_id, start_ms, score and prob. Scores and probabilities may be any type that casts to
decimal(19,17); sums of counts times scores stay within decimal(38).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from callgrid.operators import scans

# fixed values: window, cooldown, least samples, drop of means, least mean probability, trend length
WINDOW_MS, COOLDOWN_MS, MIN_SAMPLES, DROP, MIN_PROB, TREND_MS = 30_000, 90_000, 3, "0.4", "0.7", 60_000
EXACT = "decimal(19,17)"


def drop_windows(signals: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """Windows whose mean score falls by DROP or more from the window right before: call_id, alert_ms.
    Means are compared by cross-multiplication, so that no digit is lost."""
    w = signals.groupBy("call_id", F.expr(f"start_ms div {window_ms}").alias("w")).agg(
        F.count(F.lit(1)).cast("smallint").alias("n"), F.sum(F.col("score").cast(EXACT)).cast("decimal(25,17)").alias("s"), F.sum(F.col("prob").cast(EXACT)).cast("decimal(25,17)").alias("p")
    )
    before = w.select("call_id", (F.col("w") + 1).alias("w"), F.col("n").alias("n0"), F.col("s").alias("s0"), F.col("p").alias("p0"))
    both = w.join(before, ["call_id", "w"]).filter((F.col("n") >= MIN_SAMPLES) & (F.col("n0") >= MIN_SAMPLES))
    fall = F.col("s0") * F.col("n") - F.col("s") * F.col("n0") >= F.lit(DROP).cast("decimal(2,1)") * (F.col("n") * F.col("n0")).cast("decimal(9,0)")
    sure = F.col("p") + F.col("p0") >= F.lit(MIN_PROB).cast("decimal(2,1)") * (F.col("n") + F.col("n0")).cast("decimal(6,0)")
    return both.filter(fall & sure).select("call_id", ((F.col("w") + 1) * window_ms).cast("long").alias("alert_ms"))


def cooled(alerts: Column, cooldown_ms: int = COOLDOWN_MS) -> Column:
    """Of an array of times, those at least the cooldown after the one kept last."""
    empty = F.array().cast("array<bigint>")
    return F.aggregate(F.array_sort(alerts), empty, lambda kept, t: F.when((F.size(kept) == 0) | (t - F.try_element_at(kept, F.lit(-1)) >= cooldown_ms), F.concat(kept, F.array(t))).otherwise(kept))


def alerts(signals: DataFrame, window_ms: int = WINDOW_MS, cooldown_ms: int = COOLDOWN_MS) -> DataFrame:
    """call_id, alert_ms after the cooldown. A call's windows are few, however many its signals."""
    by_call = drop_windows(signals, window_ms).groupBy("call_id").agg(F.collect_list("alert_ms").alias("a"))
    return by_call.select("call_id", F.explode(cooled(F.col("a"), cooldown_ms)).alias("alert_ms"))


def long_alerts(signals: DataFrame, window_ms: int = WINDOW_MS, cooldown_ms: int = COOLDOWN_MS) -> DataFrame:
    """``alerts`` for calls of any length."""
    return scans.kept_apart(drop_windows(signals, window_ms), "call_id", "alert_ms", cooldown_ms)


def _weighted(signals: DataFrame, order: list[Column], name: str) -> DataFrame:
    w = Window.partitionBy("call_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = signals.withColumn("_before", F.coalesce(F.sum("dur").over(w), F.lit(0))).filter(F.col("_before") < TREND_MS)
    sums = inside.groupBy("call_id").agg(F.sum(F.col("score").cast(EXACT) * F.col("dur").cast("decimal(12,0)")).alias("sw"), F.sum("dur").cast("long").alias(f"{name}_ms"))
    return sums.select("call_id", f"{name}_ms", F.when(F.col(f"{name}_ms") > 0, F.col("sw").cast("double") / F.col(f"{name}_ms")).alias(f"{name}_mean"))


def speech_trend(signals: DataFrame, tie: str = "signal_id") -> DataFrame:
    """Duration-weighted mean score of a call's first and last TREND_MS of speech, and their difference."""
    both = _weighted(signals, [F.col("start_ms"), F.col(tie)], "first").join(_weighted(signals, [F.desc("start_ms"), F.desc(tie)], "last"), "call_id")
    return both.filter("first_ms > 0 and last_ms > 0").withColumn("delta", F.col("last_mean") - F.col("first_mean"))


def signed_score(classes: Column) -> Column:
    """From a map of class probabilities (positive, neutral, negative): score, top probability, or null
    where they do not add up to 1 within 0.02."""
    total = F.aggregate(F.map_values(classes), F.lit(0.0), lambda a, x: a + x)
    p = lambda k: F.coalesce(F.try_element_at(classes, F.lit(k)), F.lit(0.0))
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), p("positive") - p("negative")))
    return F.when(F.abs(total - 1) <= 0.02, F.struct(score.alias("score"), F.array_max(F.map_values(classes)).alias("prob")))


def call_sentiment(utterances: DataFrame, signals: DataFrame, limit: int = 2000) -> DataFrame:
    """Status of each call: UNAVAILABLE without customer speech, UNKNOWN where a signal is missing, else OK;
    with the number of the first `limit` final customer utterances that were scored."""
    w = Window.partitionBy("call_id").orderBy("start_ms", "id")
    spoken = utterances.filter("is_final and role = 'CUSTOMER'").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit)
    scored = spoken.join(signals.select("call_id", "id", "score"), ["call_id", "id"], "left")
    sums = scored.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"))
    rows = utterances.select("call_id").distinct().join(sums, "call_id", "left")
    return rows.select("call_id", F.coalesce("scored", F.lit(0)).alias("scored"), F.when(F.col("n").isNull(), "UNAVAILABLE").when(F.col("scored") < F.col("n"), "UNKNOWN").otherwise("OK").alias("status"))
