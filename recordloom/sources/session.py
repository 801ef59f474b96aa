"""What a session needs to run this package's functions on executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once a context, so that their Python workers can import it wherever they run, and
    make Arrow batches smaller unless the session has a size of its own.

    The archive is made on the driver and handed out by Spark's own file server."""
    context = spark.sparkContext
    if not getattr(context, "_recordloom_shipped", False) and _PACKAGE.is_dir():
        folder = tempfile.mkdtemp(prefix="recordloom-package-")
        archive = f"{folder}/recordloom.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(_PACKAGE.rglob("*.py")):
                z.write(f, f"recordloom/{f.relative_to(_PACKAGE)}")
        context.addPyFile(archive)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context._recordloom_shipped = True
    if not spark._jsparkSession.sessionState().conf().contains(_BATCH):
        spark.conf.set(_BATCH, "2000")  # rows hold whole texts, and a batch is in memory several times over
    return spark


_local: dict[str, str] = {}
_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local session gets a folder of its own; a cluster
    must name one, as the executors' local disks aren't shared."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _local:
        _local["dir"] = tempfile.mkdtemp(prefix="recordloom-")
        atexit.register(shutil.rmtree, _local["dir"], ignore_errors=True)
    return f"file://{_local['dir']}"


def _clean(path: str, app: str) -> None:
    context = SparkContext._active_spark_context
    if context is not None and context.applicationId == app:
        hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(context._jsc.hadoopConfiguration()).delete(hadoop, True)


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the shared folder. It is deleted when the driver's Python ends while the context lives."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/recordloom/{app}"
    if path not in _cleaned:
        _cleaned.add(path)
        atexit.register(_clean, path, app)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what several plans use is made once, and outlives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A small table of fewer files than there are cores, each of which may be a single row group and so a single task,
    dealt out to all cores. Tables of more files, or of more splits than cores, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores and df._jdf.rdd().getNumPartitions() <= cores:
        return df.repartition(cores)
    return df
