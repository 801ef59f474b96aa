"""Reading and writing the tables of a linkage run. All text is string, missing text is "", schemas are explicit."""

from __future__ import annotations

import io
import itertools
import json
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = T.StructType([T.StructField(n, T.StringType()) for n in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(n, T.StringType()) for n in ("source1_entity_id", "matched_entity_ids")])
#: Rows of a result that are shown.
MOST_SHOWN = 1000
NEVER = "\u0000"  # no text equals it, so "NA" and the like stay data


def assert_schema(df: DataFrame, names: list[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RAW, columns: list[str] | None = None) -> DataFrame:
    """A TSV with a header, gzip, bzip2, zstd or zip by its suffix; malformed rows are kept as far as they parse, see
    ``malformed_rows``. Adds row_pos, whose order is that of the file."""
    df = _read_csv(spark, path, schema)
    df = df.select(*columns) if columns else df
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in df.columns], F.monotonically_increasing_id().alias("row_pos"))


def _unzipped(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the members of zip archives, which Spark can't split: an archive is read by one task, line by line, without
    being held in memory as text."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    for member in sorted(archive.namelist()):
                        with archive.open(member) as f:
                            found = enumerate(io.TextIOWrapper(f, encoding="utf-8", newline="\n"))
                            while part := list(itertools.islice(found, 1 << 14)):
                                values = [x.rstrip("\r\n") for i, x in part if i]
                                yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], names=["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, "value string")


def _read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    reader = spark.read.schema(schema).option("sep", "\t").option("nullValue", NEVER).option("emptyValue", "").option("quote", "").option("mode", "PERMISSIVE")
    if not path.endswith(".zip"):
        return reader.option("header", True).csv(path)
    options = {"sep": "\t", "nullValue": NEVER, "emptyValue": "", "quote": "", "mode": "PERMISSIVE"}
    return _unzipped(spark, path).select(F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), options).alias("r")).select("r.*")


def malformed_rows(spark: SparkSession, path: str, schema: T.StructType = RAW) -> int:
    """Lines with more or fewer fields than the schema, to be warned of; they are read as far as they parse."""
    lines = _unzipped(spark, path) if path.endswith(".zip") else spark.read.text(path)
    return lines.where((F.col("value") != "") & (F.size(F.split("value", "\t")) != len(schema))).count()


def require(spark: SparkSession, *paths: str) -> None:
    """Raises FileNotFoundError that names every path that isn't there."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    missing = [p for p in paths if not (x := hadoop(p)).getFileSystem(conf).exists(x)]
    if missing:
        raise FileNotFoundError(f"not there: {', '.join(missing)}")


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first rows by position; ``limit`` would take any."""
    positions = df.select("row_pos").orderBy("row_pos").limit(n).agg(F.max("row_pos")).first()[0]
    return df.where(F.col("row_pos") <= (-1 if positions is None else positions))


def read_prepared(spark: SparkSession, path: str, split: str | None = None, source: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """A prepared table, partitioned by split and source: Parquet, or TSV by its files."""
    df = read_published(spark, path)
    if split is not None:
        df = df.where(F.col("split") == split)
    if source is not None:
        df = df.where(F.col("source") == source)
    return df.select(*columns) if columns else df


def published(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> int:
    """Write to a folder beside ``path``, count what can be read back, and only then rename it to ``path``."""
    spark = df.sparkSession
    partial = f"{path}.partial-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    if kind == "parquet":
        writer.parquet(partial)
        n = spark.read.parquet(partial).count()
    elif kind == "tsv":
        writer.option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "").option("quote", "").csv(partial)
        n = spark.read.option("sep", "\t").option("header", True).csv(partial).count()
    else:
        raise ValueError(f"unknown kind {kind!r}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = hadoop(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # the old table is moved aside, not deleted: whatever fails, one of the two is there, and ``recovered`` finds it
    old = hadoop(f"{path}.old")
    if fs.exists(target):
        fs.delete(old, True)
        if not fs.rename(target, old):
            raise OSError(f"could not rename {path}")
    if not fs.rename(hadoop(partial), target):
        fs.rename(old, target)
        raise OSError(f"could not rename {partial} to {path}")
    fs.delete(old, True)
    return n


def recovered(spark: SparkSession, path: str) -> str:
    """``path``, after putting back the old table if a run ended between the two renames."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, old = hadoop(path), hadoop(f"{path}.old")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target) and fs.exists(old):
        fs.rename(old, target)
    return path


def read_published(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table of ``published``, in the format that its files have."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = hadoop(recovered(spark, path)).getFileSystem(conf).listFiles(hadoop(path), True)
    while files.hasNext():
        name = files.next().getPath().getName()
        if name.startswith("part-"):
            if ".csv" in name:
                reader = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("nullValue", NEVER).option("emptyValue", "")
                return (reader.schema(schema) if schema else reader).csv(path)
            break
    return spark.read.parquet(path)


def write_single(df: DataFrame, path: str, order: str | None = None) -> int:
    """One TSV file at ``path`` with a header, rows in the order of a column that isn't written. For results that are handed
    over as a file; one task writes it, streaming. The file appears by a rename when it is whole."""
    spark = df.sparkSession
    partial = f"{path}.partial-{uuid.uuid4().hex}"
    rows = df.orderBy(order).drop(order) if order else df
    rows.coalesce(1).write.option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "").option("quote", "").csv(partial)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    [part] = [f.getPath() for f in fs.listStatus(hadoop(partial)) if f.getPath().getName().startswith("part-")]
    fs.delete(hadoop(path), False)
    if not fs.rename(part, hadoop(path)):
        raise OSError(f"could not rename {part} to {path}")
    fs.delete(hadoop(partial), True)
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path).count()


#: Of the layout of saved indexes and vocabularies.
INDEX_VERSION = 1


def save_index(df: DataFrame, path: str, kind: str, settings: str) -> int:
    """An index or vocabulary and, written last, what it is: without that row it can't be loaded."""
    n = published(df, f"{path}/rows")
    meta = df.sparkSession.createDataFrame([(INDEX_VERSION, kind, settings, n)], "version int, kind string, settings string, n_rows long")
    published(meta.coalesce(1), f"{path}/meta")
    return n


def load_index(spark: SparkSession, path: str, kind: str, settings: str | None = None) -> DataFrame:
    """What ``save_index`` wrote. Raises ValueError if it is cut short, of another version, blocker or settings."""
    require(spark, f"{path}/meta", f"{path}/rows")
    meta, rows = spark.read.parquet(f"{path}/meta").first(), spark.read.parquet(f"{path}/rows")
    if meta.version != INDEX_VERSION or meta.kind != kind:
        raise ValueError(f"{path} is of {meta.kind}, version {meta.version}, not {kind}, version {INDEX_VERSION}")
    if settings is not None and meta.settings != settings:
        raise ValueError(f"{path} was made with other settings: {meta.settings}")
    if (n := rows.count()) != meta.n_rows:
        raise ValueError(f"{path} has {n} of {meta.n_rows} rows")
    return rows


def split_matches(c: F.Column) -> F.Column:
    """Ids in a comma-joined list, without blanks; an empty text has none."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(s1_id, matches, n_true) with entities of no match, and (s1_id, target_id, source)."""
    rows = read_tsv(spark, path, TRUTH)
    s1 = rows.select(F.col("source1_entity_id").alias("s1_id"), split_matches(F.col("matched_entity_ids")).alias("matches"), "row_pos").withColumn("n_true", F.size("matches").cast("long"))
    pairs = s1.select("s1_id", F.explode("matches").alias("target_id")).distinct().withColumn("source", F.substring("target_id", 2, 1).cast("int"))
    return s1, pairs


def manifest(records: DataFrame) -> DataFrame:
    """Rows by split and source, the denominators of all rates."""
    return records.groupBy("split", "source").agg(F.count("*").alias("rows"))


def only_wanted(records: DataFrame, ids: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """Records whose id is in ``ids``, before anything wide is computed on them."""
    return records.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")


def write_report(values: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(values, f, indent=2, sort_keys=True, default=float)


def markdown_table(df: DataFrame, digits: int = 4) -> str:
    """A small result as a Markdown table, in the order of its rows; of larger ones the first ``MOST_SHOWN``, and how many
    there are isn't told."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    lines = [df.columns, ["-"] * len(df.columns), *[[show(v) for v in row] for row in df.limit(MOST_SHOWN).collect()]]
    return "\n".join("|" + "|".join(line) + "|" for line in lines)
