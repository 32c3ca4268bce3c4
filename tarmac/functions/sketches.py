"""Quantile sketches as grouped aggregates: KLL by Spark's own functions, t-digest in two Arrow stages."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

K, COMPRESSION = 200, 250.0
#: Values held for a group before they are folded into its digest.
BUFFER = 4096
#: Digests that are merged at a time.
FAN = 64


def kll_quantiles(value: str, ranks: Sequence[float], k: int = K) -> list[Column]:
    """A KLL sketch of float32 values and its quantiles at inclusive ranks; randomised once a group exceeds exact storage."""
    sketch = F.kll_sketch_agg_float(F.col(value).cast("float"), k)
    return [F.kll_sketch_get_quantile_float(sketch, F.lit(float(q))).cast("double") for q in ranks]


def kll_states(df: DataFrame, keys: Sequence[str], value: str, k: int = K) -> DataFrame:
    """``keys`` and state: the KLL sketch of float32 values of each group, as bytes to store. Groups without values are left out."""
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_float(F.col(value).cast("float"), k).alias("state"))


def kll_merged(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States by fewer keys, from states alone: the rows are not read again."""
    return states.groupBy(*keys).agg(F.kll_merge_agg_float("state").alias("state"))


def kll_read(states: DataFrame, keys: Sequence[str], ranks: dict[str, float], digits: int = 2) -> DataFrame:
    """``keys`` and the quantiles of their states at inclusive ranks."""
    return states.select(*keys, *[F.round(F.kll_sketch_get_quantile_float("state", F.lit(float(q))).cast("double"), digits).alias(n) for n, q in ranks.items()])


def rank_errors(df: DataFrame, found: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """``keys``, percentile, and rank_error: how far a found quantile lies from its rank among the group's values, ties in its favour."""
    long = found.unpivot(list(keys), list(ranks), "percentile", "_q")
    wanted = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")).join(long, list(keys))
    below, upto = (F.count_if(c) / F.count("*") for c in (F.col("_v") < F.col("_q"), F.col("_v") <= F.col("_q")))
    out = rows.groupBy(*keys, "percentile").agg(below.alias("_a"), upto.alias("_b"))
    rank = wanted[F.col("percentile")]
    return out.select(*keys, "percentile", F.greatest(F.col("_a") - rank, rank - F.col("_b"), F.lit(0.0)).alias("rank_error"))


def compress(means, weights, compression: float = COMPRESSION):
    """Centroids merged in their order while each spans at most one unit of the arcsine scale."""
    import numpy as np

    order = np.argsort(means, kind="stable")
    means, weights = np.asarray(means, float)[order], np.asarray(weights, float)[order]
    total = weights.sum()
    if len(means) <= 1 or total <= 0:
        return means, weights
    scale = lambda q: compression / (2 * math.pi) * math.asin(2 * min(1.0, max(0.0, q)) - 1)
    out_m, out_w, before = [means[0]], [weights[0]], 0.0
    low = scale(0.0)
    for m, w in zip(means[1:], weights[1:], strict=True):
        if scale((before + out_w[-1] + w) / total) - low <= 1:
            out_w[-1] += w
            out_m[-1] += (m - out_m[-1]) * w / out_w[-1]
        else:
            before += out_w[-1]
            low = scale(before / total)
            out_m.append(m)
            out_w.append(w)
    return np.array(out_m), np.array(out_w)


def digest_quantile(means, weights, q: float) -> float | None:
    """Interpolated between the midpoints of neighbouring centroids; the outermost centroids bound the ends."""
    import numpy as np

    if not len(means):
        return None
    middle = np.cumsum(weights) - np.asarray(weights) / 2
    return float(np.interp(q * float(np.sum(weights)), middle, means))


def tdigest_quantiles(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, float], digits: int = 2, compression: float = COMPRESSION) -> DataFrame:
    """``keys`` and a quantile column per rank. Null values are left out, and a group of nulls with them.

    Each task folds its rows into a digest per group, so only centroids are shuffled. The digests of a group (one
    per task) are merged ``FAN`` at a time, in as many levels as that takes, so a merge has a bounded number of
    centroids however many tasks there are.
    """
    keys = list(keys)
    part = T.StructType([*(df.schema[k] for k in keys), T.StructField("_s", T.LongType()), T.StructField("_m", T.ArrayType(T.DoubleType())), T.StructField("_w", T.ArrayType(T.DoubleType()))])

    def fold(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        digests: dict[tuple, list] = {}
        types = None
        for b in batches:
            types = [b.schema.field(i).type for i in range(len(keys))]
            table = pa.Table.from_batches([b])
            names = table.schema.names
            for row in table.group_by(names[:-1]).aggregate([(names[-1], "list")]).to_pylist():
                key = tuple(row[n] for n in names[:-1])
                held = digests.setdefault(key, [np.zeros(0), np.zeros(0)])
                new = np.array(row[f"{names[-1]}_list"], float)
                for lo in range(0, len(new), BUFFER):
                    chunk = new[lo : lo + BUFFER]
                    values, counts = np.unique(chunk, return_counts=True)
                    held[:] = compress(np.concatenate([held[0], values]), np.concatenate([held[1], counts]), compression)
        if digests:
            cols = [pa.array([k[i] for k in digests], types[i]) for i in range(len(keys))]
            cols.append(pa.array([TaskContext.get().partitionId()] * len(digests), pa.int64()))
            lists = [pa.array([list(d[i]) for d in digests.values()], pa.list_(pa.float64())) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*cols, *lists], part.names)

    def joined(table):
        import numpy as np

        return compress(np.concatenate(table["_m"].to_pylist()), np.concatenate(table["_w"].to_pylist()), compression)

    def level(table):
        import pyarrow as pa

        m, w = joined(table)
        return pa.table({**{k: table[k].slice(0, 1) for k in [*keys, "_s"]}, **{n: pa.array([list(v)], pa.list_(pa.float64())) for n, v in (("_m", m), ("_w", w))}})

    def merge(table):
        import pyarrow as pa

        m, w = joined(table)
        found = {n: digest_quantile(m, w, q) for n, q in ranks.items()}
        return pa.table({**{k: table[k].slice(0, 1) for k in keys}, **{n: pa.array([v], pa.float64()) for n, v in found.items()}})

    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(n, T.DoubleType()) for n in ranks)])
    digests, tasks = rows.mapInArrow(fold, part), rows.rdd.getNumPartitions()
    while tasks > FAN:
        digests = digests.withColumn("_s", F.floor(F.col("_s") / FAN)).groupBy(*keys, "_s").applyInArrow(level, part)
        tasks = -(-tasks // FAN)
    out = digests.groupBy(*keys).applyInArrow(merge, schema)
    return out.select(*keys, *[F.round(n, digits).alias(n) for n in ranks])
