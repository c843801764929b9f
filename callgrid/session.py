"""Session set-up."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each Spark context. Arrow batches are
    bounded in bytes, so that rows of long texts don't add up; a bound that the user has set stays."""
    sc = spark.sparkContext
    if sc.getConf().get(ARROW_BYTES) is None:
        spark.conf.set(ARROW_BYTES, str(8 << 20))
    if getattr(sc, "_callgrid_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="callgrid-"), "callgrid.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._callgrid_shipped = True


def work_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where none is set, a local one for a
    plain local master, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = getattr(work_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="callgrid-")
        work_dir.own = where
    return where.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The table as written to the shared folder: lineage ends there, and every reader sees the same rows."""
    path = f"{work_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
