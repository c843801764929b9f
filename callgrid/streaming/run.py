"""Runs a stream over what its source holds, and gives what it wrote as a table."""

from __future__ import annotations

import contextlib
import sys
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql.streaming import StatefulProcessor

from callgrid.session import work_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Timers, maps and times to live need the RocksDB state store; a query keeps the one it starts with."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def keyed(rows: GroupedData, processor: StatefulProcessor, schema: str, time: str) -> DataFrame:
    """The rows of each key through a stateful processor. Spark first looks at a processor in a Python process
    that has none of the files sent to the executors, so it is sent whole, with the module that it is from."""
    module = sys.modules[type(processor).__module__]
    cloudpickle.register_pickle_by_value(module)
    try:
        return rows.transformWithStateInPandas(processor, schema, "append", time)
    finally:
        cloudpickle.unregister_pickle_by_value(module)


def drained(stream: DataFrame, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Runs the stream until its source is read and its timers up to the watermark have fired (one with
    timers or times to live of the clock never ends, and is to be started as any other). checkpoint
    and out: folders, new ones in the shared folder by default; with those of an earlier run, it goes on."""
    spark = stream.sparkSession
    base = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = out or f"{base}/out"
    with keyed_state(spark):
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint or f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
    return spark.read.schema(stream.schema).parquet(out)


def streamed(rows: DataFrame, files_a_batch: int | None = None) -> DataFrame:
    """A table as a stream: it is written to a new folder in the shared one, which the stream reads."""
    spark = rows.sparkSession
    path = f"{work_dir(spark)}/source-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    reader = spark.readStream.schema(rows.schema)
    return (reader if files_a_batch is None else reader.option("maxFilesPerTrigger", files_a_batch)).parquet(path)
