"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder under the warehouse where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarmac-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tarmac_path = path
    return out


#: Rows of a written table (a few numbers each) that one task may take over, to save the exchanges of short joins.
GATHERED_ROWS = 50_000


def gathered(table: DataFrame, rows: int = GATHERED_ROWS) -> DataFrame:
    """A written table in a single partition if its count shows that it is small; else as it is."""
    path = getattr(table, "_tarmac_path", None)
    if path is None or table.count() > rows:
        return table
    out = table.coalesce(1)
    out._tarmac_path = path
    return out


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no later step reads."""
    for table in tables:
        if path := getattr(table, "_tarmac_path", None):
            deleted(table.sparkSession, path)


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, lengthened until no column has that name (in any case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
