"""The flight table: its schema, loader and view, and the same table as a view over ``lineitem``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DOUBLES = ("CANCELLED", "DIVERTED")
#: The causes' columns, and the names of their means.
CAUSES = ("CARRIER_DELAY", "WEATHER_DELAY", "NAS_DELAY", "SECURITY_DELAY", "LATE_AIRCRAFT_DELAY")
CAUSE_MEANS = ("avg_carrier_delay", "avg_weather_delay", "avg_nas_delay", "avg_security_delay", "avg_late_aircraft_delay")

SCHEMA = T.StructType(
    [T.StructField("OP_UNIQUE_CARRIER", T.StringType()), T.StructField("YEAR", T.IntegerType()), T.StructField("MONTH", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in _DOUBLES]
    + [T.StructField("CRS_DEP_TIME", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in ("DEP_DELAY", "ARR_DELAY", *CAUSES)]
)
LOOKUP = T.StructType([T.StructField("Code", T.StringType()), T.StructField("Description", T.StringType())])

#: Fixed values of the fixture.
_CARRIERS = ("AA", "DL", "UA", "WN", "AS", "B6", "F9", "G4", "HA", "MQ", "NK", "OH", "OO", "YX")


def _fixture() -> str:
    carrier = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CARRIERS[:-1]))
    arrival = "l_quantity - 20 + l_linenumber"
    late = f"l_partkey % 50 <> 0 AND l_orderkey % 97 <> 0 AND {arrival} >= 15"
    lines = ("IN (1,2)", "= 3", "= 4", "= 5", ">= 6")
    causes = ", ".join(f"CASE WHEN {late} THEN CASE WHEN l_linenumber {x} THEN {arrival} ELSE CAST(0 AS DOUBLE) END END AS {c}" for x, c in zip(lines, CAUSES, strict=True))
    return f"""SELECT CASE l_suppkey % {len(_CARRIERS)} {carrier} ELSE '{_CARRIERS[-1]}' END AS OP_UNIQUE_CARRIER,
 CAST(year(l_shipdate) AS INT) AS YEAR, CAST(month(l_shipdate) AS INT) AS MONTH,
 CAST(CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS CANCELLED,
 CAST(CASE WHEN l_partkey % 50 <> 0 AND l_orderkey % 97 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS DIVERTED,
 CAST((l_orderkey % 24) * 100 + l_linenumber * 7 AS INT) AS CRS_DEP_TIME,
 CASE WHEN l_partkey % 50 = 0 OR l_partkey % 211 = 5 THEN NULL ELSE l_quantity - 12 END AS DEP_DELAY,
 CASE WHEN l_partkey % 50 = 0 OR l_orderkey % 97 = 0 THEN NULL ELSE {arrival} END AS ARR_DELAY,
 {causes}
FROM lineitem"""


#: The fixture, in SQL that Spark and DuckDB both run.
FIXTURE_SQL = _fixture()


def checked(df: DataFrame) -> DataFrame:
    """``df`` with the columns of the flight schema, cast to its types; a missing column is an error."""
    have = {c.upper(): c for c in df.columns}
    if missing := [f.name for f in SCHEMA if f.name not in have]:
        raise ValueError(f"flight table lacks {', '.join(missing)}")
    return df.select(*[df[have[f.name]].cast(f.dataType).alias(f.name) for f in SCHEMA])


def load_flights(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet directory of flights, whatever numeric types its files have."""
    return checked(spark.read.parquet(path))


def register(flights: DataFrame, name: str = "flights") -> DataFrame:
    flights.createOrReplaceTempView(name)
    return flights


def fixture_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``FIXTURE_SQL`` over a directory's ``lineitem``, without leaving a view behind."""
    return spark.sql(FIXTURE_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def ingest_csv(spark: SparkSession, source: str, target: str) -> None:
    """Raw CSV with a header into the Parquet table, partitioned by year and month; unreadable numbers become null."""
    raw = spark.read.option("header", True).csv(source)
    store_flights(raw.select(*[c.alias(f.name) for f, c in _typed(raw)]), target)


def store_flights(flights: DataFrame, target: str, *above: str) -> None:
    """The table partitioned by year and month (under ``above``). Rows are dealt out by partition first, and a large one to several tasks, so that there are few files."""
    by = (*above, "YEAR", "MONTH")
    flights.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(target)


def flights_of(spark: SparkSession, path: str, years: Sequence[int] | None = None, months: DataFrame | None = None) -> DataFrame:
    """A stored table's flights of some years, and of the (YEAR, MONTH) rows of a table; only their folders are read.

    Years are known when the query is planned. Which months the table names is known once it is read; if it is small
    enough to be broadcast, its values prune the folders before the scan begins.
    """
    out = load_flights(spark, path)
    if years is not None:
        out = out.where(F.col("YEAR").isin(*years))
    return out if months is None else out.join(months.select("YEAR", "MONTH"), ["YEAR", "MONTH"], "left_semi").select(*[f.name for f in SCHEMA])


def ingest_checked(spark: SparkSession, source: str, target: str) -> None:
    """Raw CSV into accepted and rejected rows, written by one pass over it.

    A row with a value that its column's type cannot hold is rejected whole. Rejected rows keep their readable
    values, ``reasons`` (column and raw value of each that is not), the file, and the row's place in its part of it.
    """
    raw = spark.read.option("header", True).csv(source).withColumns({"_file": F.col("_metadata.file_name"), "_row": F.monotonically_increasing_id()})
    typed = _typed(raw)
    have = {c.upper(): c for c in raw.columns}
    bad = [F.when(raw[have[f.name]].isNotNull() & c.isNull(), F.struct(F.lit(f.name).alias("column"), raw[have[f.name]].alias("value"))) for f, c in typed if f.name in have]
    reasons = F.filter(F.array(*bad), lambda r: r.isNotNull())
    rows = raw.select(*[c.alias(f.name) for f, c in typed], reasons.alias("reasons"), F.col("_file").alias("file"), F.col("_row").bitwiseAND((1 << 33) - 1).alias("row"))
    store_flights(rows.withColumn("accepted", (F.size("reasons") == 0).cast("int")), target, "accepted")


def rejected(spark: SparkSession, target: str) -> DataFrame:
    """The rejected rows of ``ingest_checked``; none are an empty table."""
    return spark.read.parquet(target).where("accepted = 0").drop("accepted")


def accepted(spark: SparkSession, target: str) -> DataFrame:
    return checked(spark.read.parquet(target).where("accepted = 1"))


def _typed(raw: DataFrame) -> list[tuple[T.StructField, Column]]:
    """The flight columns of raw text: of unreadable values and missing columns null."""
    have = {c.upper(): c for c in raw.columns}
    return [(f, raw[have[f.name]].try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)) for f in SCHEMA]
