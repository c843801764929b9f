"""What a task holds at once, and work that must not be done twice."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgrid.operators import wer
from callgrid.sources import files


class Pairs:
    """A table whose mapInPandas hands back the function of the tasks."""

    schema = T.StructType([T.StructField("call_id", T.LongType())])

    def select(self, *columns):
        return self

    def mapInPandas(self, run, schema):  # noqa: N802
        return run


def test_attribution_sends_frames_of_bounded_size():
    text = "one two three four " * 100
    batch = pd.DataFrame({"call_id": range(100), "reference": text, "utterances": [[{"id": "u", "text": text + "five"}]] * 100})
    frames = list(wer.attributions(Pairs())(iter([batch, batch])))
    assert sum(map(len, frames)) == 2 * 100 * 401 and max(map(len, frames)) <= wer.OUT_ROWS
    assert [f["position"].iloc[0] for f in frames][:2] == [0, wer.OUT_ROWS % 401]


def test_each_case_is_parsed_once(spark):
    """Once for its own faults and once for repeated identifiers; a filter or a field does not parse it again."""
    lines = spark.range(3).select(F.concat(F.lit('{"case_id":"case-'), F.col("id") % 2, F.lit('"}')).alias("raw")).union(spark.createDataFrame([(None,), ("no json",)], "raw string"))
    faults = files.case_faults(files.parsed_cases(lines))
    want = [("case-0", "fields"), ("case-0", "fields"), ("case-0", "repeated"), ("case-1", "fields"), (None, "fields"), (None, "fields"), (None, "repeated")]
    assert sorted(map(tuple, faults.collect()), key=str) == want
    plan = faults._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("from_json(StructField(") <= 2 * 2  # the test's lines are a union of two tables
