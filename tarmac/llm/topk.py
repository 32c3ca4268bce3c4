"""Exact top-k inner products by sequential reads of sorted lists without random access.

Each dimension is a list of the candidates sorted by their component; a query reads it from the top for
a positive weight and from the bottom for a negative one. An entry carries the candidate's norm beside its
component. After equal reads from every list a candidate's score is bounded by what was read of it and,
for the lists in which it was not met, by the value that the list has reached, its worst value, and the
Cauchy-Schwarz bound of the weights and of the norm that are left. A query stops reading once few
candidates can still be among its k best; only those are scored in full.

Queries meet candidates in blocks, whose lists are read for all queries of a block together as matrix
products, and the blocks' best are merged. A task has a cell of some candidate and some query blocks; what a query
has found in the cell's earlier blocks is a bar for the next, so that fewer entries are read there.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.batches import mapped
from tarmac.llm.storage import written

#: Candidates and queries in a block, on average.
BLOCK, QUERY_BLOCK = 4096, 1024
#: Candidate blocks are dealt to so many groups, or more if a group would have over CELL of them; query blocks to groups of at most CELL.
GROUPS, CELL = 32, 16
#: Shares of the lists at which the bounds are compared; candidates that may be left, as a share.
DEPTHS, LEFT = (1 / 8, 1 / 4, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1.0), 1 / 32
#: Bits up to which sums of whole doubles are exact; beyond, scores are added as Python integers.
EXACT_BITS = 53
_FAR = 1 << 400


def _bounds(c, rank, lists, q, read: int, low: bool = True):
    """Lower (None unless ``low``) and upper bounds of every candidate's score for each query, after ``read`` entries of every list."""
    import numpy as np

    n = len(c)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    known = {}
    for side, w, met, reached, worst in ((1, up, rank >= n - read, lists[n - read], lists[0]), (0, down, rank < read, lists[read - 1], lists[-1])):
        values = np.where(met, c, 0.0)
        known[side] = (w @ values.T, w @ np.where(met, 0.0, reached).T, w @ np.where(met, 0.0, worst).T if low else 0.0, (w * w) @ (~met).T.astype(float), (w != 0).astype(float) @ (values * values).T)
    score, most, least, weights, norms = (a + b for a, b in zip(known[0], known[1], strict=True))
    rest = np.sqrt(weights * np.maximum((c * c).sum(1) - norms, 0.0)) * (1 + 1e-9)
    return score + np.maximum(least, -rest) if low else None, score + np.minimum(most, rest)


def lists_topk(queries, query_ids, candidates, candidate_ids, k: int, times=None, reads: list | None = None, bars=None, first: float = 0.0):
    """(query row, candidate row, score) of each query's k best candidates of other ids, ties to smaller ids.

    Components are whole doubles. A candidate counts ``times`` over. The entries read by each query are
    added to ``reads``. Scores below a query's bar, which others have reached k times, may be left out; bounds
    are first compared when the share ``first`` of the lists is read.
    """
    import numpy as np

    out: list[tuple[int, int, int]] = []
    n, dims = candidates.shape
    if not n or not len(queries):
        return out
    c, q_all = candidates.astype(float), queries.astype(float)
    times = np.ones(n, np.int64) if times is None else times
    most = float(np.abs(c).max(initial=0)) * float(np.abs(q_all).max(initial=0)) * max(dims, 1)
    exact = most < 1 << EXACT_BITS

    def resolve(row: int, rows) -> None:
        rows = rows[candidate_ids[rows] != query_ids[row]]
        if exact:
            scores = [int(x) for x in c[rows] @ q_all[row]]
        else:
            weights = [int(x) for x in q_all[row]]
            scores = [sum(int(x) * w for x, w in zip(v, weights, strict=True)) for v in c[rows]]
        best = sorted(range(len(rows)), key=lambda i: (-scores[i], candidate_ids[rows[i]]))
        left = k
        for i in best[:k]:
            copies = min(left, int(times[rows[i]]))
            out.extend([(row, int(rows[i]), scores[i])] * copies)
            left -= copies
            if not left:
                break

    order = np.argsort(c, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None].repeat(dims, 1), 0)
    lists = np.take_along_axis(c, order, 0)
    active = np.arange(len(q_all))
    bars = np.full(len(q_all), -np.inf) if bars is None else bars
    for depth in DEPTHS:
        if not len(active):
            break
        if depth < first:
            continue
        read = max(1, min(n, round(depth * n)))
        q = q_all[active]
        bar = bars[active]
        low = n > k and bool(np.isneginf(bar).any())
        lower, upper = _bounds(c, rank, lists, q, read, low)
        own = candidate_ids[None, :] == query_ids[active][:, None]
        upper[own] = -np.inf
        if low:
            lower[own] = -np.inf
            bar = np.maximum(bar, np.partition(lower, n - k, axis=1)[:, n - k])
        may = (upper >= (bar - 1e-9 * most)[:, None]) & ~own
        done = (may.sum(1) <= max(4 * k, LEFT * n)) | (read == n)
        for i in np.flatnonzero(done):
            resolve(active[i], np.flatnonzero(may[i]))
            if reads is not None:
                reads.append(read * dims)
        active = active[~done]
    return out


def topk_search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "components") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products over all vectors.

    Both frames hold a whole-number id and an array of whole numbers (doubles, which are exact to 2^53,
    or longs), without nulls in the array. A row is no candidate of a query with its own id. Vectors of
    another length than the query's are no candidates. Repeated rows are candidates each, and repeated
    query rows are answered each. Null ids take no part. Fewer than k candidates give fewer rows, none give
    none. A score outside the range of long is ranked by its value and returned as null.
    """

    def blocks(df: DataFrame, name: str, size: int) -> tuple[DataFrame, int]:  # and their number
        kept = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        # equal rows are one row with a count, so that they fill no block
        kept = written(kept.groupBy("id", "v").agg(F.count("*").alias("times")))
        n = max(1, -(-kept.count() // size))
        kept = kept.withColumn(name, F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")).withColumn("dims", F.size("v"))
        return kept.groupBy("dims", name).agg(F.collect_list(F.struct("id", "v", "times", F.xxhash64("v").alias("tag"))).alias(f"{name}_rows")), n

    each_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left, n = blocks(vectors, "c", BLOCK)
    right, m = blocks(queries, "q", QUERY_BLOCK)
    groups, halls = max(min(n, GROUPS), -(-n // CELL)), -(-m // CELL)
    cell = ["dims", "g", "h"]
    left = left.select("dims", (F.col("c") % groups).alias("g"), each_of(halls).alias("h"), "c_rows").repartition(4 * groups * halls, *cell)
    right = right.select("dims", each_of(groups).alias("g"), (F.col("q") % halls).alias("h"), "q", "q_rows").repartition(4 * groups * halls, *cell)
    # never a broadcast: the queries, once for each group, are estimated at what their file has
    pairs = left.hint("merge").join(right.hint("merge"), cell).select(*cell, "q", "c_rows", "q_rows")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def matrix(rows, dims: int):
            ids, times, tags = (rows.field(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            return ids, rows.field(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dims), times, tags

        names = ["query_id", "tag", "times", "vec_id", "score", "high", "digits"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
        at_cell, found = None, {}
        for b in batches:
            for i in range(b.num_rows):
                *now, block = (b.column(x)[i].as_py() for x in range(4))
                if now != at_cell:
                    at_cell, found = now, {}
                dims = now[0]
                c_ids, c, c_times, _ = matrix(b.column(4)[i].values, dims)
                q_ids, q, q_times, tags = matrix(b.column(5)[i].values, dims)
                # the k best scores of each query in the cell, and where to compare bounds first
                best, first = found.get(block) or (np.full((len(q_ids), k), -np.inf), 0.0)
                rows, reads = [], []
                for at, to, score in lists_topk(q, q_ids, c, c_ids, k, c_times, reads, best.min(1), first):
                    high, mine = float(score), best[at]
                    if high < (bar := mine.min()):
                        continue
                    if high > bar:
                        mine[mine.argmin()] = high
                    long = -(1 << 63) <= score < 1 << 63
                    # whole scores sort by a rounded value first, and where that may have been rounded by their digits
                    rows.append((q_ids[at], tags[at], q_times[at], c_ids[to], score if long else None, high, f"{score + _FAR:0150d}" if abs(high) >= 1 << EXACT_BITS else None))
                found[block] = best, float(np.median(reads)) / (len(c_ids) * dims) - 1 / 8 if reads and dims else 0.0
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

    found = mapped(pairs, run, "query_id long, tag long, times long, vec_id long, score long, high double, digits string")
    w = Window.partitionBy("query_id", "tag").orderBy(F.desc("high"), F.desc("digits"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return best.withColumn("_n", each).select("query_id", "rank", "vec_id", "score")


def whole_components(embedding: str = "embedding") -> Column:
    """floor(256 x) of every component as a whole double; null for a vector that is null or holds a null or non-finite one.

    A component whose 256-fold is beyond the doubles counts as non-finite.
    """
    v = F.transform(F.col(embedding).cast("array<double>"), lambda x: x * 256)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    # from 2^53 on every double is whole, and floor() would leave the range of long
    whole = lambda x: F.when(F.abs(x) < F.lit(float(1 << 53)), F.floor(x).cast("double")).otherwise(x)
    return F.when(v.isNotNull() & ~F.exists(v, bad), F.transform(v, whole))


def op9_sorted_list_topk(spark, sf_dir: str) -> DataFrame:
    """The 5 highest scores over all vectors for every vector whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", whole_components().alias("components"))
    return topk_search(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


#: The same rows by DuckDB.
OP9_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
    CAST(list_sum([q.c[i] * v.c[i] FOR i IN range(1, len(q.c) + 1)]) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.c) = len(v.c)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
FROM s QUALIFY "rank" <= 5
"""
