"""Streams of given batches."""

import json
import os


def source(spark, folder, schema, batches, late=()):
    """A stream with a batch for each list of rows."""
    folder.mkdir(exist_ok=True)
    for i, rows in enumerate(batches):
        path = folder / f"{i:03}.json"
        path.write_text("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(path, (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
