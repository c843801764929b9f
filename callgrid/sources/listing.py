"""A data source that lists files below a folder, without their content: path, size, modified."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, size bigint, modified timestamp"


class Folder(InputPartition):
    """Files of a folder: those right in it, or all below it."""

    def __init__(self, base: str, below: bool):
        super().__init__(base)
        self.base, self.below = base, below


class ListingReader(DataSourceReader):
    """Folders down to `depth` levels become partitions, so that the tasks do the listing. Paths are relative
    to the source's; those that don't begin with `prefix` are left out, and folders that can't hold any
    aren't visited."""

    def __init__(self, options: dict[str, str]):
        self.uri, self.prefix, self.depth = options["path"], options.get("prefix", ""), int(options.get("depth", "1"))

    def opened(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def may_hold(self, relative: str) -> bool:
        return relative.startswith(self.prefix) or self.prefix.startswith(relative + "/")

    def partitions(self) -> list[Folder]:
        from pyarrow import fs

        system, root = self.opened()
        out, now = [], [root]
        for _ in range(self.depth):
            inner = [f.path for base in now for f in system.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.Directory and self.may_hold(f.path[len(root) :].lstrip("/"))]
            out, now = out + [Folder(b, False) for b in now], inner
        return out + [Folder(b, True) for b in now]

    def read(self, partition: Folder) -> Iterator[tuple]:
        from pyarrow import fs

        system, root = self.opened()
        for f in system.get_file_info(fs.FileSelector(partition.base, recursive=partition.below)):
            relative = f.path[len(root) :].lstrip("/")
            if f.type == fs.FileType.File and relative.startswith(self.prefix):
                yield relative, f.size, f.mtime.astimezone() if f.mtime is not None else None


class Listing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ListingReader(self.options)


def listed(spark: SparkSession, path: str, prefix: str = "", depth: int = 1) -> DataFrame:
    """path, size and modified of every file below a folder (of any store that Arrow opens) whose relative path
    begins with the prefix."""
    module = sys.modules[__name__]  # Spark plans with it in a process that has none of the files sent to executors
    cloudpickle.register_pickle_by_value(module)
    try:
        spark.dataSource.register(Listing)
    finally:
        cloudpickle.unregister_pickle_by_value(module)
    return spark.read.format("file_listing").option("prefix", prefix).option("depth", str(depth)).load(path)
