"""What several of these operators share: scratch tables, held-out remainders, joins that survive hot keys."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.session import scratch_dir

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join is broadcast only below this many bytes, counted before the join is planned.
BROADCAST_BYTES = 64 << 20



def trim() -> None:
    """Give memory that a batch has freed back to the system: Python workers live on between tasks, beside the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc
        pass


def trim_driver(spark: SparkSession) -> str | None:
    """The same for the driver's JVM, which plans and compiles dozens of queries in a row: its garbage is collected once the heap
    has grown to half of what it may have, and what its compilers have freed goes back to the system, where the JVM offers that (it says what it did)."""
    jvm = spark._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        jvm.java.lang.System.gc()
    try:  # by the interface's method, as the server's own class isn't open to others
        forName, array = jvm.java.lang.Class.forName, spark.sparkContext._gateway.new_array
        names = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        for i, name in enumerate(names):
            kinds[i] = forName(name)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        method = forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        return method.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:  # another JVM
        return None


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. Cuts the lineage at a table that outlives lost executors,
    and fixes what depends on the order of rows (block numbers, row numbers) once and for all."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``stage``, but bucketed by ``key``: later joins and groups by it don't shuffle these rows again. The table's
    name is dropped at once, its files stay. There are as many buckets as shuffle partitions, or as ``df`` has partitions if
    those are more."""
    spark = df.sparkSession
    table = f"recordloom_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    buckets = min(most, max(int(spark.conf.get("spark.sql.shuffle.partitions")), df._jdf.rdd().getNumPartitions()))
    df.write.option("path", path).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(table)
    trim_driver(spark)
    out = spark.table(table)
    out.schema  # the plan has its files and buckets now
    spark.sql(f"DROP TABLE {table}")
    return out


def boxed(df: DataFrame) -> Column:
    """All columns of ``df`` as one, so that none of their names can clash with others."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, mod ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row of ``groups`` per key, where any key may own a large share of the rows.

    ``groups[size]`` is the key's number of rows, ``total`` the sum. Keys with over a thousandth of all rows number
    under a thousand, so these are broadcast and their rows never move; no other key has over a thousandth of the
    rows, so the rest is shuffled by key evenly.
    """
    hot = F.col(size) * 1000 > max(total, 1_000_000)
    few = F.broadcast(groups.where(hot))
    warm = rows.join(few, key)
    cold = rows.join(few.select(key), key, "left_anti").join(groups.where(~hot), key)
    return warm.unionByName(cold)
