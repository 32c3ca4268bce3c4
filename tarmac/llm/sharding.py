"""Proportional stratified interleaving into shards, by built-in functions only.

Rows of each source are shuffled by a seeded hash and ranked; row r of a source with n rows has the
fractional rank (r - 1/2) / n. All rows in the order of that fraction are cut into equal runs, so that
each shard holds every source in the proportion of the whole, within a row or so per source.

No window spans a source or the table. Ranks are counted in two steps: the hash range is cut into
buckets (more buckets for more rows), a row is ranked within its (source, bucket), and the rows of the
buckets before it are added from a table of counts. The same is done for the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.storage import free_name, written

#: Rows in a bucket, on average; buckets at least.
BUCKET_ROWS, BUCKETS = 2048, 64
_SPAN = 1 << 31


def _prefix_of_bucket(counts: DataFrame, by: list[str], bucket: str, n: str, out: str) -> DataFrame:
    """The count of rows in the buckets before, by a running sum over the counts alone."""
    w = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(n).over(w), F.lit(0)))


def interleave(df: DataFrame, shards: int, source: str | Column = "source", order: list[str | Column] | None = None, seed: int = 17) -> DataFrame:
    """``df`` with the columns shard (int) and slot (long), numbered from 0 without gaps in each shard.

    Law: shard sizes differ by one row at most, and each shard holds a source in proportion.
    ``order`` are the columns that the seeded shuffle hashes; it decides the result alone, so equal
    inputs give equal shards whatever their partitions. Rows equal in all of ``order`` are tied and
    interchangeable. A null source is a source of its own; nulls in ``order`` hash as nulls. An empty
    table gives an empty result. Existing columns keep their names and values: if one is called shard
    or slot, the new one gets a trailing underscore.
    """
    kept = df.columns
    order = [F.col(c) if isinstance(c, str) else c for c in (order if order is not None else kept)]
    names: dict[str, str] = {}
    for x in ("shard", "slot", "_h", "_s", "_b", "_r", "_before", "_size", "_f", "_fb", "_at", "_n"):
        names[x] = free_name([*kept, *names.values()], x)
    c = lambda x: F.col(names[x])
    of = F.col(source) if isinstance(source, str) else source
    rows = df.count()
    buckets = max(BUCKETS, -(-rows // BUCKET_ROWS))
    mixed = F.xxhash64(F.lit(seed), *order)
    rows_df = df.withColumn(names["_h"], mixed).withColumn(names["_s"], of)
    rows_df = rows_df.withColumn(names["_b"], F.pmod(F.shiftrightunsigned(c("_h"), 33), F.lit(_SPAN)) * buckets / _SPAN)
    rows_df = rows_df.withColumn(names["_b"], F.floor(c("_b")))

    # rank within a source: within its bucket, then the buckets before
    counts = rows_df.groupBy(names["_s"], names["_b"]).agg(F.count("*").alias(names["_n"]))
    before = _prefix_of_bucket(counts, [names["_s"]], names["_b"], names["_n"], names["_before"])
    before = before.withColumn(names["_size"], F.sum(names["_n"]).over(Window.partitionBy(names["_s"]))).drop(names["_n"])
    mine, theirs = rows_df.alias("m"), before.alias("t")
    joined = mine.join(theirs, F.col(f"m.{names['_s']}").eqNullSafe(F.col(f"t.{names['_s']}")) & (F.col(f"m.{names['_b']}") == F.col(f"t.{names['_b']}")))
    joined = joined.select("m.*", f"t.{names['_before']}", f"t.{names['_size']}")
    within = Window.partitionBy(names["_s"], names["_b"]).orderBy(F.pmod(c("_h"), F.lit(1 << 62)), *order)
    ranked = joined.withColumn(names["_r"], F.row_number().over(within) + c("_before"))
    # the fraction as an exact integer pair would overflow; a double holds (2r - 1) / 2n well enough and ties fall to the hash
    ranked = ranked.withColumn(names["_f"], (2 * c("_r") - 1) / (2 * c("_size")))
    ranked = ranked.withColumn(names["_fb"], F.least(F.floor(c("_f") * buckets), F.lit(buckets - 1)))
    ranked = ranked.drop(names["_b"], names["_r"], names["_before"], names["_size"])

    # rank among all rows, in the order of the fraction
    counts = ranked.groupBy(names["_fb"]).agg(F.count("*").alias(names["_n"]))
    group = F.floor(c("_fb") / 1024)
    upper = counts.groupBy(group.alias(names["_r"])).agg(F.sum(names["_n"]).alias(names["_size"]))
    upper = _prefix_of_bucket(upper, [], names["_r"], names["_size"], names["_before"]).drop(names["_size"])
    lower = _prefix_of_bucket(counts.withColumn(names["_r"], group), [names["_r"]], names["_fb"], names["_n"], names["_at"])
    starts = lower.join(upper, names["_r"]).select(names["_fb"], (c("_at") + c("_before")).alias(names["_at"]))
    placed = ranked.join(starts, names["_fb"])
    within = Window.partitionBy(names["_fb"]).orderBy(c("_f"), c("_h"), *order)
    placed = placed.withColumn(names["_at"], c("_at") + F.row_number().over(within) - 1)

    # row i of n goes to shard floor(i * shards / n); a shard begins at ceil(shard * n / shards)
    n = F.lit(max(rows, 1)).cast("long")
    at = c("_at").cast("long")
    shard = F.expr(f"int(({names['_at']} * {shards}L) div {max(rows, 1)}L)")
    placed = placed.withColumn(names["shard"], shard)
    begin = F.floor((c("shard").cast("long") * n + F.lit(shards - 1)) / F.lit(shards)).cast("long")
    placed = placed.withColumn(names["slot"], at - begin)
    return placed.select(*kept, names["shard"], names["slot"])


def op4_interleaved_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards: sizes and checksums of the texts, shard and slot."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "source", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    out = interleave(written(docs), 16, order=["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
