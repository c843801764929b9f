"""Evaluation of predicted findings and scores against gold ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_rule(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """gold: case_id, rule_id, critical; predicted: case_id, rule_id. Counts, precision and recall by rule; a
    ratio without a base is null."""
    both = gold.withColumn("g", F.lit(1)).join(predicted.distinct().withColumn("p", F.lit(1)), ["case_id", "rule_id"], "full")
    g, p = F.col("g").isNotNull(), F.col("p").isNotNull()
    crit = F.coalesce("critical", F.lit(False))
    sums = both.groupBy("rule_id").agg(
        F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(crit).alias("critical_gold"), F.count_if(crit & ~p).alias("critical_missed")
    )
    return sums.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))


def report(cases: DataFrame, dims: DataFrame) -> DataFrame:
    """cases: case_id, excluded, abstained; dims: case_id, gold, predicted. One row; excluded cases leave all
    figures, abstained ones only the score agreement."""
    eligible = cases.filter(~F.col("excluded"))
    counts = cases.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("excluded").alias("explicitly_excluded"), F.count_if(~F.col("excluded")).alias("eligible"), F.count_if(~F.col("excluded") & F.col("abstained")).alias("abstained")
    )
    judged = eligible.join(dims, "case_id")
    err = F.when(~F.col("abstained"), F.abs(F.col("predicted").cast("double") - F.col("gold").cast("double")))
    scores = judged.agg(
        F.count(F.lit(1)).alias("applicable_dimensions"), F.count(err).alias("adjudicated_dimensions"), F.round(F.avg(err), 6).alias("mean_absolute_error"), F.count_if(err == 0).alias("exact_matches")
    )
    one = counts.join(scores)  # one row on either side
    return (
        one.withColumn("covered", F.col("eligible") - F.col("abstained"))
        .withColumn("coverage", F.try_divide("covered", "eligible"))
        .withColumn("excluded_dimensions", F.col("applicable_dimensions") - F.col("adjudicated_dimensions"))
        .withColumn("exact_agreement", F.try_divide("exact_matches", "adjudicated_dimensions"))
    )
