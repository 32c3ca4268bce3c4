"""Mixing to target weights by iterative proportional fitting.

Token weights are summed by cell (a source, language and topic). The cells are raked: scaled along one
margin after the other until every margin has its target share. A document's calibrated weight is the
factor of its cell; its probability is that factor over the largest one, so that the sample has the
target shares without repeating a document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.batches import mapped, slices
from tarmac.llm.storage import dropped, free_name, written
from tarmac.llm.tokens import pieces, tokenizer_path

#: Cells that may be raked in the driver and broadcast (some 100 bytes each); more are raked by Spark.
DRIVER_CELLS = 50_000
#: Repeated hashes (16 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_HASHES = 500_000
#: Rounds end when every margin is within the tolerance of its target, or when so many rounds have not brought the
#: worst one nearer by a hundredth, as where targets contradict each other.
TOLERANCE, PATIENCE = 1e-9, 20
TEMPERATURE = 0.9


def topic(text: Column) -> Column:
    """The kind of a whole text: legal, contact, table, code, or prose by its length."""
    n = F.length(text)
    return (
        F.when(text.contains("Licensed under") | text.contains("Copyright"), "legal")
        .when(text.contains("@"), "contact")
        .when(text.contains(" | "), "table")
        .when(text.contains("{") | text.contains("</"), "code")
        .when(n < 1000, "short prose")
        .when(n < 8000, "prose")
        .when(n.isNotNull(), "long prose")
    )


def targets_of(totals: list[tuple], target: dict | float) -> dict:
    """Target shares by value: tempered shares for a number; for a dict its shares, the rest in proportion to what is there."""
    total = sum(t for _, t in totals)
    if not total:
        return {}
    if not isinstance(target, dict):
        raised = {v: (t / total) ** target for v, t in totals if t > 0}
        return {v: x / sum(raised.values()) for v, x in raised.items()}
    named = {v: target[v] for v, t in totals if v in target and t > 0}
    others = {v: t for v, t in totals if v not in target and t > 0}
    left = max(0.0, 1 - sum(named.values())) if others else 0.0
    out = named | {v: left * t / sum(others.values()) for v, t in others.items()}
    norm = sum(out.values())
    return {v: x / norm for v, x in out.items()} if norm else {}


class _Rounds:
    """Whether another round of fitting is worth while, by the worst margin of each round so far."""

    def __init__(self):
        self.worst: list[float] = []

    def go_on(self, worst: float) -> bool:
        self.worst.append(worst)
        before = self.worst[-1 - PATIENCE] if len(self.worst) > PATIENCE else math.inf
        return worst >= TOLERANCE and worst < 0.99 * before


def raked(cells: list[tuple], tokens: list[float], targets: list[dict]) -> tuple[list[float], float]:
    """The factor of each cell after proportional fitting to the targets of each margin in turn, and how far the worst margin is from its target."""
    import numpy as np

    total = sum(tokens)
    mass = np.array(tokens, float) / total if total else np.zeros(len(tokens))
    start = mass.copy()
    codes, goals = [], []
    for d, target in enumerate(targets):
        values = {v: i for i, v in enumerate(dict.fromkeys(c[d] for c in cells))}
        codes.append(np.array([values[c[d]] for c in cells], dtype=np.int64))
        goals.append(np.array([target.get(v, 0.0) for v in values]))
    rounds, error = _Rounds(), 0.0
    while True:
        for code, goal in zip(codes, goals, strict=True):
            have = np.bincount(code, mass, len(goal))
            mass = mass * np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)[code]
        error = max((float(np.abs(np.bincount(code, mass, len(goal)) - goal).max(initial=0)) for code, goal in zip(codes, goals, strict=True)), default=0.0)
        if not rounds.go_on(error):
            break
    return list(np.divide(mass, start, out=np.zeros_like(mass), where=start > 0)), error


def _raked_by_spark(cells: DataFrame, dims: list[str], targets: dict) -> tuple[DataFrame, float]:
    """``raked`` for cells that the driver should not hold: every step is a grouped sum and a join by one margin."""
    total = cells.agg(F.sum("_tokens")).first()[0] or 1
    now = written(cells.withColumn("_start", F.col("_tokens") / total).withColumn("_mass", F.col("_tokens") / total))
    goals = []
    for d in dims:
        have = cells.groupBy(F.col(d).alias("_v")).agg(F.sum("_tokens").alias("_t")).where("_t > 0")
        target = targets.get(d, TEMPERATURE)
        if isinstance(target, dict):
            named = F.create_map(*[F.lit(x) for kv in target.items() for x in kv]) if target else F.lit(None)
            raw = have.withColumn("_named", F.try_element_at(named, F.col("_v")) if target else F.lit(None).cast("double"))
            s = raw.agg(F.coalesce(F.sum("_named"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("_named").isNull(), F.col("_t"))), F.lit(0)).cast("double")).first()
            left = max(0.0, 1 - s[0]) if s[1] else 0.0
            goal = raw.withColumn("_g", F.coalesce("_named", F.lit(left) * F.col("_t") / F.lit(s[1] or 1.0)))
        else:
            goal = have.withColumn("_g", F.pow(F.col("_t") / total, F.lit(target)))
        norm = goal.agg(F.sum("_g")).first()[0] or 1.0
        goals.append(written(goal.select("_v", (F.col("_g") / norm).alias("_g"))))
    rounds = _Rounds()
    while True:
        worst = 0.0
        for d, goal in zip(dims, goals, strict=True):
            have = now.groupBy(F.col(d).alias("_w")).agg(F.sum("_mass").alias("_have"))
            factors = written(have.join(goal, F.col("_v").eqNullSafe(F.col("_w")), "left").select("_w", F.coalesce("_g", F.lit(0.0)).alias("_g"), "_have"))
            # before it is scaled, a margin shows what the others have left of it
            worst = max(worst, factors.agg(F.max(F.abs(F.col("_have") - F.col("_g")))).first()[0] or 0.0)
            scale = F.when(F.col("_have") > 0, F.col("_g") / F.col("_have")).otherwise(0.0)
            new = written(now.join(factors, F.col(d).eqNullSafe(F.col("_w"))).select(*dims, "_tokens", "_start", (F.col("_mass") * scale).alias("_mass")))
            dropped(now, factors)
            now = new
        if not rounds.go_on(worst):
            break
    dropped(*goals)
    return now.select(*dims, F.when(F.col("_start") > 0, F.col("_mass") / F.col("_start")).otherwise(0.0).alias("_weight")), worst


def mix(df: DataFrame, evidence: DataFrame, dims: list[str], tokens: str, targets: dict, seed: int = 29, key: list[str] | None = None, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """``df`` with weight (the raked factor), margin_error, probability and sampled (1 or 0).

    ``evidence`` has ``dims`` and ``tokens`` of all documents (``df`` or what it was made from); ``targets``
    maps a dimension to shares by value, or to a temperature that its shares are raised to (``TEMPERATURE``
    where it is missing). margin_error, the same in every row, is how far the worst margin's share of the raked
    tokens is from its target: above the tolerance where targets contradict each other. Null values are values of their own. Documents without tokens weigh 0 in the sums
    but are drawn with their cell's probability; a cell of no tokens at all, or of a value with target 0, is
    never drawn. Each row has its own lot, by ``key`` (all columns where it is missing) and, where rows are equal in
    it, by the row: null and repeated ids are drawn like others. New columns get trailing underscores where ``df``
    has their names.
    """
    spark = df.sparkSession
    cells = written(evidence.groupBy(*dims).agg(F.coalesce(F.sum(F.col(tokens).cast("double")), F.lit(0.0)).alias("_tokens")))
    small = cells.count() <= driver_cells
    if small:
        rows = sorted(map(tuple, cells.collect()), key=repr)
        goals = []
        for d in range(len(dims)):
            sums: dict = {}
            for r in rows:
                sums[r[d]] = sums.get(r[d], 0.0) + r[-1]
            goals.append(targets_of(list(sums.items()), targets.get(dims[d], TEMPERATURE)))
        weights, error = raked([r[:-1] for r in rows], [r[-1] for r in rows], goals)
        schema = ", ".join(f"`{d}` {cells.schema[d].dataType.simpleString()}" for d in dims) + ", _weight double"
        table = spark.createDataFrame([(*r[:-1], float(w)) for r, w in zip(rows, weights, strict=True)], schema)
        most = max(weights, default=0.0)
    else:
        fitted, error = _raked_by_spark(cells, dims, targets)
        table = written(fitted)
        most = table.agg(F.max("_weight")).first()[0] or 0.0
    dropped(cells)
    same = reduce(lambda a, b: a & b, [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in dims])
    names: list[str] = []
    for x in ("weight", "margin_error", "probability", "sampled"):
        names.append(free_name([*df.columns, *names], x))
    out = df.alias("d").join((F.broadcast(table) if small else table).alias("t"), same, "left").select("d.*", F.coalesce("t._weight", F.lit(0.0)).alias(names[0]), F.lit(error).alias(names[1]))
    out = out.withColumn(names[2], F.col(names[0]) / F.lit(most or 1.0))
    return _drawn(out, names[2], names[3], seed, key or df.columns)


def _drawn(df: DataFrame, probability: str, name: str, seed: int, key: list[str]) -> DataFrame:
    """``df`` with ``name``, 1 or 0 by each row's own lot: a hash of ``key``, and for rows equal in it of the row's number too.

    Rows that repeat a hash are found by counting hashes. Their numbers go by partition and place, so that how
    many of equal rows are drawn has the right expectation; which of them, says nothing.
    """
    h, n, again = (free_name(df.columns, x) for x in ("_hash", "_number", "_again"))
    lots = df.withColumns({h: F.xxhash64(F.lit(seed), *key), n: F.monotonically_increasing_id()})
    repeated = written(lots.groupBy(h).agg(F.count("*").alias("_c")).where("_c > 1").select(h, F.lit(True).alias(again)))
    out = lots.join(F.broadcast(repeated) if repeated.count() <= BROADCAST_HASHES else repeated, h, "left")
    lot = F.when(F.col(again), F.xxhash64(F.lit(seed), h, n)).otherwise(F.col(h))
    share = F.pmod(lot, F.lit(1 << 52)) / F.lit(float(1 << 52))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (share < F.col(probability)).cast("int").alias(name))


def topical(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the topic of each whole text (a null text is an empty one), and that column's name. Rows are read one by one."""
    name = free_name(docs.columns, "_topic")
    return docs.withColumn(name, topic(F.coalesce(F.col("text"), F.lit("")))), name


def described(docs: DataFrame, keep: list[str], path: str | None = None) -> tuple[DataFrame, str, str]:
    """Columns ``keep``, the topic and the number of the vocabulary's ids (no end id) of each whole text, and the names of those two.

    A null or empty text has none; repeated rows have a row each; kept columns may be null.
    """
    known, kind = topical(docs)
    count = free_name([*docs.columns, kind], "_ids")
    path = path or tokenizer_path()
    kept = [*keep, kind]
    schema = T.StructType([*(known.schema[c] for c in kept), T.StructField(count, T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = pieces(path).ids
        for b in slices(batches):
            n = [len(encode(text)) // 4 for text in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(n, pa.int64())], [*kept, count])

    return mapped(known.select(*kept, F.col("text")), run, schema), kind, count


def targets(topic_col: str) -> dict:
    """The production targets: shares of sources, languages and topics raised to ``TEMPERATURE``."""
    return {"source": TEMPERATURE, "lang": TEMPERATURE, topic_col: TEMPERATURE}


def op10_raked_mixture(spark, sf_dir: str) -> DataFrame:
    """Every document's cell, tokens, raked weight and probability, and whether it is drawn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    known, kind, ids = described(docs.withColumn("_text", F.xxhash64("text")), ["doc_id", "source", "lang", "_text"])
    known = written(known)
    out = mix(known, known, ["source", "lang", kind], ids, targets(kind), key=["doc_id", "_text"]).drop("_text")
    return out.withColumnsRenamed({kind: "topic", ids: "n_tokens"})
