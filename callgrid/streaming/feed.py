"""The event feed as a sink: gapless numbers by tenant, bounded history, purges and resumable reads.

A feed is a folder: `events/batch=N` holds what the N-th batch of a stream appended, `counters/batch=N` each
tenant's last number after it, `floors` the numbers below which purges have removed everything. A batch
is numbered from the counters of the batch before it, and writes its own two folders anew; so a batch that is
repeated after a failure gets the same numbers, and nothing twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from callgrid.operators import operations
from callgrid.operators.scope import Scope
from callgrid.session import work_dir
from callgrid.sources.files import event_frame

COUNTERS, FLOORS = "organisation_id string, last long", "organisation_id string, floor long"
NUMBERS = "organisation_id string, sequence long"


class Feed:
    """A feed in a folder. schema: its columns without organisation_id and sequence; call_id is one of them."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, history: int = operations.HISTORY):
        self.spark, self.path, self.history = spark, path.rstrip("/"), history
        own = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns = [f.name for f in own.fields]
        self.schema = StructType.fromDDL(NUMBERS)
        for f in own.fields:
            self.schema.add(f.name, f.dataType)
        self.stored = StructType([*self.schema.fields]).add("batch", "long")

    def _folder(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _batches(self, name: str) -> list[int]:
        at, fs = self._folder(name)
        found = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[len("batch=") :]) for n in found if n.startswith("batch="))

    def _drop(self, name: str) -> None:
        at, fs = self._folder(name)
        fs.delete(at, True)

    def _there(self, name: str) -> bool:
        at, fs = self._folder(name)
        return fs.exists(at)

    def counters(self, before: int | None = None) -> DataFrame:
        """organisation_id and last, after all batches or after those before a number."""
        done = [n for n in self._batches("counters") if before is None or n < before]
        return self.spark.read.schema(COUNTERS).parquet(f"{self.path}/counters/batch={done[-1]}") if done else self.spark.createDataFrame([], COUNTERS)

    def floors(self) -> DataFrame:
        """organisation_id, last and oldest: the first number that a tenant's history still has."""
        purged = self.spark.read.schema(FLOORS).parquet(f"{self.path}/floors") if self._there("floors") else self.spark.createDataFrame([], FLOORS)
        purged = purged.groupBy("organisation_id").agg(F.max("floor").alias("floor"))
        oldest = F.greatest(F.lit(1).cast("long"), F.col("last") - self.history + 1, F.coalesce("floor", F.lit(1).cast("long")))
        return self.counters().join(purged, "organisation_id", "left").select("organisation_id", "last", oldest.alias("oldest"))

    def events(self) -> DataFrame:
        """All events of the tenants' histories."""
        if not self._there("events"):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.stored).parquet(f"{self.path}/events").drop("batch")
        return rows.join(self.floors(), "organisation_id").filter("sequence >= oldest").drop("last", "oldest")

    def writer(self, *order: str) -> Callable[[DataFrame, int], None]:
        """What foreachBatch takes: appends a batch (organisation_id and the feed's columns), each tenant's rows
        in the order of these columns, the first of them a number. Rows without a tenant are left out."""

        def write(batch: DataFrame, batch_id: int) -> None:
            rows = batch.filter("organisation_id is not null").select("organisation_id", *self.columns)
            before = self.counters(batch_id)
            numbered = operations.appended(before.withColumnRenamed("last", "sequence"), rows, *order)
            numbered.select([f.name for f in self.schema.fields]).write.mode("overwrite").parquet(f"{self.path}/events/batch={batch_id}")
            new = self.spark.read.schema(self.schema).parquet(f"{self.path}/events/batch={batch_id}").groupBy("organisation_id").agg(F.max("sequence").alias("last"))
            after = before.unionByName(new).groupBy("organisation_id").agg(F.max("last").alias("last"))
            after.write.mode("overwrite").parquet(f"{self.path}/counters/batch={batch_id}")
            for old in [n for n in self._batches("counters") if n < batch_id][:-1]:  # a repeat needs the one before
                self._drop(f"counters/batch={old}")

        return write

    def purge(self, calls: DataFrame) -> DataFrame:
        """Removes the history that could tell of some calls (organisation_id, call_id): all of a tenant's events
        up to the last one of any of them. Gives organisation_id and floor of the tenants concerned. Repeating
        it changes nothing."""
        last = self.events().join(calls.select("organisation_id", "call_id").distinct(), ["organisation_id", "call_id"], "left_semi").groupBy("organisation_id").agg((F.max("sequence") + 1).alias("floor"))
        last.select(F.col("organisation_id").cast("string"), F.col("floor").cast("long")).write.mode("append").parquet(f"{self.path}/floors")
        self.sweep()
        return last

    def sweep(self) -> None:
        """Rewrites the batches that hold rows below their tenant's floor, without these."""
        if not self._there("events"):
            return
        every = self.spark.read.schema(self.stored).parquet(f"{self.path}/events")
        marked = every.join(self.floors().select("organisation_id", "oldest"), "organisation_id", "left").withColumn("_gone", F.coalesce(F.col("sequence") < F.col("oldest"), F.lit(False)))
        touched = [r["batch"] for r in marked.filter("_gone").select("batch").distinct().collect()]  # numbers of batches
        if not touched:
            return
        kept = f"{self.path}/kept"
        marked.filter(F.col("batch").isin(touched) & ~F.col("_gone")).drop("_gone", "oldest").write.mode("overwrite").partitionBy("batch").parquet(kept)
        for n in touched:
            self._drop(f"events/batch={n}")
            at, fs = self._folder(f"kept/batch={n}")
            if fs.exists(at):
                fs.rename(at, self._folder(f"events/batch={n}")[0])
        self._drop("kept")

    def read(self, scope: Scope, after: int, limit: int = operations.MAX_BATCH) -> DataFrame:
        """The tenant's next events after a cursor that the role may see, in order; one row of type
        reset_required, numbered as the feed's last, where the history no longer reaches back to the cursor.
        A cursor ahead of the feed is an error."""
        own = self.floors().filter(F.col("organisation_id") == scope.organisation_id).collect()  # a row
        last, oldest = (own[0]["last"], own[0]["oldest"]) if own else (0, 1)
        if after > last:
            raise ValueError("the cursor is ahead of the feed")
        if after >= oldest - 1:
            return operations.feed(self.events(), scope, after, limit)
        reset = [F.lit(scope.organisation_id).alias("organisation_id"), F.lit(last).cast("long").alias("sequence")]
        reset += [(F.lit("reset_required") if f.name == "event_type" else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields[2:]]
        return self.spark.range(1).select(*reset)


def frames(rows: DataFrame, payload: Column, kind: str = "event_type") -> DataFrame:
    """Rows of a feed as server-sent events; a reset carries its reason."""
    reset = F.struct(F.lit("cursor_expired").alias("reason"))
    frame = F.when(F.col(kind) == "reset_required", event_frame(F.col("sequence"), F.col(kind), reset)).otherwise(event_frame(F.col("sequence"), F.col(kind), payload))
    return rows.select("sequence", frame.alias("frame"))


def fed(stream: DataFrame, feed: Feed, *order: str, checkpoint: str | None = None) -> Feed:
    """Appends what a stream's source holds to the feed, batch by batch; with the checkpoint of an earlier run
    it goes on from there."""
    where = checkpoint or f"{feed.path}/checkpoint"
    query = stream.writeStream.foreachBatch(feed.writer(*order)).option("checkpointLocation", where).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return feed


def new_path(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/feed-{uuid.uuid4().hex}"
