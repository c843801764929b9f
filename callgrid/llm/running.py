"""Running totals over a whole table in order, without one task that holds it all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from callgrid.llm.common import n_parts, stash


def running_totals(rows: DataFrame, group: str, order: list[str], values: dict[str, str]) -> DataFrame:
    """The rows with, for each of `values` (new column: value column, of longs or doubles), the sum over
    the rows of the same group that come before it in the order. group is a whole number, never null.

    Rows are range-partitioned by group and order and summed up within each range; a window over the
    ranges' sums, of which there are no more than ranges and groups together, gives where each begins.
    """
    kinds = {new: rows.schema[old].dataType for new, old in values.items()}
    at = F.struct(F.col(group).alias("g"), F.spark_partition_id().alias("p")).alias("_range")
    dealt = rows.repartitionByRange(n_parts(rows), group, *order).sortWithinPartitions(group, *order).select("*", at)
    schema = T.StructType([*dealt.schema.fields, *[T.StructField(new, kind) for new, kind in kinds.items()]])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = np.asarray(batch.column(group))
            new = np.append(groups[0] != last, groups[1:] != groups[:-1]).astype(bool)
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            columns = []
            for name, old in values.items():
                v = np.asarray(batch.column(old))
                before = np.concatenate([[0], np.cumsum(v)[:-1]]).astype(v.dtype)
                start = np.where(head >= 0, before[head], -v.dtype.type(carried.get(name, 0)))
                columns.append(pa.array(before - start))
                carried[name] = (before - start)[-1] + v[-1]
            last = groups[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema=pa.schema([*batch.schema, *[pa.field(n, c.type) for n, c in zip(values, columns)]]))

    summed = stash(dealt.mapInArrow(total, schema))
    ends = [F.sum(old).alias(f"_sum_{new}") for new, old in values.items()]
    ranges = summed.groupBy("_range").agg(*ends)
    before = Window.partitionBy("_range.g").orderBy("_range.p").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", *[F.coalesce(F.sum(f"_sum_{new}").over(before), F.lit(0)).cast(kinds[new]).alias(f"_before_{new}") for new in values])
    # at most as many rows as ranges and groups together
    joined = summed.join(ranges, "_range")
    return joined.withColumns({new: F.col(new) + F.col(f"_before_{new}") for new in values}).drop("_range", *[f"_before_{new}" for new in values])
