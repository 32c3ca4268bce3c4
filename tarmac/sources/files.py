"""CSV readers, path probes and the session."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.sources.flights import LOOKUP


def session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in {"spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "true", **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def qualified(spark: SparkSession, path: str) -> str:
    """A path as the full address that Spark itself would read, by the session's default file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(where).toString()


#: Stores whose files tasks can open themselves.
OPENED = frozenset({"file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss"})


def store_of(address: str):
    """The Arrow file system of a full address, and the path in it. A path without a scheme is an error: which store it is in, only Spark knows."""
    from pyarrow import fs

    scheme, colon, rest = address.partition(":")
    if not colon or "/" in scheme:
        raise ValueError(f"{address} names no store; see tarmac.sources.files.qualified")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme not in OPENED:
        raise ValueError(f"tasks cannot open files of {scheme}: ({address}); they can in {', '.join(sorted(OPENED))}")
    return fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}:{rest}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder of the session, or in its warehouse."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/tarmac-{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, read from there: for results that several plans need, or to cut lineage."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns as text and nulls as empty text."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def read_csv_named(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV without a known header: columns by position as text, and rows that repeat the header left out."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).csv(path)
    df = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])
    return df.where(F.col(f"`{columns[0]}`") != columns[0])


def read_optional(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """``read_csv_named``, or no rows where nothing is there."""
    if exists(spark, path):
        return read_csv_named(spark, path, columns)
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """A lookup file of codes and descriptions."""
    return spark.read.schema(LOOKUP).option("header", True).csv(path)


def from_rows(spark: SparkSession, rows: list, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame(rows, schema)
