"""Results as the rows of a key-value store: hashes (key, field, value), rankings (key, member, score).

A later run overwrites the rows of an earlier one, so no stale key is left; scores may be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.expressions import text
from tarmac.operators.delays import CARRIER, RANKS
from tarmac.sources.flights import CAUSE_MEANS

MONTHLY = ("total_flights", "cancelled_flights", "cancellation_rate_pct", "avg_dep_delay", "min_dep_delay", "max_dep_delay")
_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def hash_rows(df: DataFrame, key: Column, fields: Sequence[tuple[Column, str]]) -> DataFrame:
    """A row per key and field; ``fields`` are pairs of a field name and the column with its value."""
    entries = F.array(*[F.struct(n.alias("field"), text(v).alias("value")) for n, v in fields])
    return df.select(key.alias("key"), F.explode(entries).alias("e")).select("key", "e.field", "e.value")


def _own(*names: str):
    return [(F.lit(n), n) for n in names]


def _by_metric(df: DataFrame, key: str, owner: Column | None, field: Column, metrics: dict[str, str]) -> DataFrame:
    """A hash per metric: key[:owner]:metric, with a field per row."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), text(v).alias("value")) for m, v in metrics.items()])
    rows = df.select(*([owner.alias("owner")] if owner is not None else []), field.alias("field"), F.explode(entries).alias("e"))
    parts = [F.lit(key), *([F.col("owner")] if owner is not None else []), F.col("e.metric")]
    return rows.select(F.concat_ws(":", *parts).alias("key"), "field", "e.value")


def q1_hash(q1: DataFrame) -> DataFrame:
    return hash_rows(q1, F.concat_ws(":", F.lit("q1"), CARRIER, "YEAR", "MONTH"), _own(*MONTHLY))


def q2_ranking(q2: DataFrame) -> DataFrame:
    return q2.select(F.lit("q2:ranking").alias("key"), F.col(CARRIER).alias("member"), F.col("avg_arr_delay").alias("score"))


def q2_hash(q2: DataFrame) -> DataFrame:
    return hash_rows(q2, F.concat_ws(":", F.lit("q2"), CARRIER), _own("num_flights", "avg_arr_delay", *CAUSE_MEANS))


def q3_hash(q3: DataFrame) -> DataFrame:
    return hash_rows(q3, F.concat_ws(":", F.lit("q3:percentiles"), CARRIER, "hour"), _own(*RANKS))


def q1_viz(q1: DataFrame) -> DataFrame:
    """By month label; of several years the last one's value stands, as a later write replaces an earlier one."""
    label = F.element_at(F.array(*[F.lit(m) for m in _MONTHS]), F.col("MONTH"))
    last = Window.partitionBy(CARRIER, "MONTH").orderBy(F.desc("YEAR"))
    rows = q1.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return _by_metric(rows, "q1:viz", F.col(CARRIER), label, {"avg_dep_delay": "avg_dep_delay", "cancellation_rate": "cancellation_rate_pct"})


def q2_viz(q2: DataFrame) -> DataFrame:
    return _by_metric(q2, "q2:viz", None, F.col(CARRIER), {c: c for c in CAUSE_MEANS})


def q3_viz(q3: DataFrame) -> DataFrame:
    return _by_metric(q3, "q3:viz", F.col(CARRIER), F.lpad(F.col("hour").cast("string"), 2, "0"), {p: p for p in RANKS})


def as_maps(rows: DataFrame) -> DataFrame:
    """key and fields (a map): one row per hash."""
    return rows.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))


def hash_of(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col("key") == key).select("field", "value")


def top(ranking: DataFrame, n: int = 3) -> DataFrame:
    """The highest scores; ties by member."""
    return ranking.orderBy(F.desc("score"), "member").limit(n).select("member", "score")


def entries(hashes: DataFrame | None = None, ranking: DataFrame | None = None) -> DataFrame:
    """Hash rows and ranking rows as rows of a key-value store: key, field, value, score."""
    parts = []
    if hashes is not None:
        parts.append(hashes.select("key", "field", "value", F.lit(None).cast("double").alias("score")))
    if ranking is not None:
        parts.append(ranking.select("key", F.col("member").alias("field"), F.lit(None).cast("string").alias("value"), F.col("score").cast("double").alias("score")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def hashes_of(stored: DataFrame) -> DataFrame:
    return stored.where("value IS NOT NULL").select("key", "field", "value")


def rankings_of(stored: DataFrame) -> DataFrame:
    return stored.where("value IS NULL").select("key", F.col("field").alias("member"), "score")


def publish(rows: DataFrame, connect) -> None:
    """Write hash rows, or rows of ``entries``, through clients that ``connect`` opens in each task.

    A client has hset(key, field, value), and for rankings zadd(key, {member: score}); a member without a score is left out.
    """

    def send(part) -> None:
        client = connect()
        for r in part:
            if r["value"] is not None:
                client.hset(r["key"], r["field"], r["value"])
            elif r["score"] is not None:
                client.zadd(r["key"], {r["field"]: r["score"]})

    rows.foreachPartition(send)


def latest(stored: DataFrame, by: str, value: str = "value") -> DataFrame:
    """key and the value of its last field in the order of ``by`` (a panel's reduction to the last value)."""
    return stored.groupBy("key").agg(F.max_by(value, by).alias("last"))


def renamed(stored: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rows whose field names are shown under other names; fields that are not in ``names`` keep theirs."""
    shown = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return stored.withColumn("field", F.coalesce(shown[F.col("field")], "field"))
