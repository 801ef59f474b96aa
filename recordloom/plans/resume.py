"""Stage results that are used again as long as what they were made from stays the same."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import published


def fingerprint(spark: SparkSession, inputs: Sequence[str], settings: object = None) -> str:
    """A hash of the settings and of the inputs' files: their paths, lengths and times of change."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for name in sorted(inputs):
        path = jvm.org.apache.hadoop.fs.Path(name)
        files = path.getFileSystem(conf).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps([sorted(found), repr(settings)]).encode()).hexdigest()


def resumed(spark: SparkSession, path: str, inputs: Sequence[str], make: Callable[[], DataFrame], settings: object = None) -> DataFrame:
    """The table at ``path``, made anew unless it was published under the fingerprint of these inputs and settings.

    A table is published whole or not at all, under a folder of its fingerprint, so a run that broke off leaves nothing
    that a later one would take for a result.
    """
    own = f"{path}/{fingerprint(spark, inputs, settings)}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        published(make(), own)
    return spark.read.parquet(own)
