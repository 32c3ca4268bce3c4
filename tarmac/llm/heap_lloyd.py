"""Product codes of vectors by Lloyd rounds that rescan only what may have changed, found by heaps.

A vector is cut into parts, and each part position has a codebook. Vectors live in blocks of some thousand rows,
written between rounds. A block keeps, for each part position and entry, a heap of the parts assigned to the
entry, keyed by how much nearer the entry was than the next when the part was last scanned (lower minus upper
bound), plus what the entry had drifted by then. When entries move, the drift of each (its own way and the
longest way of any other) is added up; only parts whose key the drift has reached are popped and compared with
all entries again, and only those that changed entry change the sums. All else is known to be nearest still.

Distances are of whole numbers and exact. Keys are rounded down and drifts up, so equal distances are always
popped and ties go to the lower entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.batches import mapped, slices
from tarmac.llm.storage import dropped, written

PARTS, ENTRIES, ROUNDS, STEPS = 16, 64, 2, 256
#: Rows and bytes of a block; row numbers take ROW_BITS of a heap's items, and keys count in 1 / FINE.
BLOCK_ROWS, BLOCK_BYTES, ROW_BITS, FINE = 4096, 4 << 20, 16, 1 << 10
#: Components saturate here, which keeps every sum of squares within a long.
MOST = 1 << 24
_FAR = 1 << 45


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 x), saturated at plus or minus 2^24."""
    return np.clip(np.floor(STEPS * x.astype(np.float64)), -MOST, MOST).astype(np.int32)


def kept(df: DataFrame, vector: str, vec_id: str, label: str) -> DataFrame:
    """_id, _l and _x (doubles) of rows whose vector is not null and has no component that is null or not finite."""
    x = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{vec_id}`").alias("_id"), F.col(f"`{label}`").alias("_l"), x.alias("_x"))
    return rows.where(F.col("_x").isNotNull() & F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


class Codebooks:
    """Entries (a matrix of entry and component) of all part positions, and what each has drifted."""

    def __init__(self, entries: np.ndarray, parts: int = PARTS, drift: np.ndarray | None = None):
        self.entries, self.parts = entries.astype(np.int64), parts
        self.cuts = [i * entries.shape[1] // parts for i in range(parts + 1)]
        self.drift = np.zeros((parts, len(entries)), np.int64) if drift is None else drift

    def part(self, p: int) -> slice:
        return slice(self.cuts[p], self.cuts[p + 1])

    def nearest(self, x: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of part ``p`` of each row (ties to the lower), and how much nearer it is than any other, rounded down."""
        own = x[:, self.part(p)].astype(np.int64)
        d = np.zeros((len(x), len(self.entries)), np.int64)
        for i, c in enumerate(self.entries[:, self.part(p)].T):
            d += (own[:, i, None] - c[None]) ** 2
        a = d.argmin(1)
        at = np.arange(len(x))
        upper = np.sqrt(d[at, a].astype(float))
        d[at, a] = np.iinfo(np.int64).max
        gap = np.sqrt(d.min(1).astype(float)) - upper if d.shape[1] > 1 else np.full(len(x), np.inf)
        return a, np.minimum(np.floor(np.minimum(gap, _FAR / FINE) * FINE) - 1, _FAR).astype(np.int64)

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Entries at the floors of their parts' means (unused ones stay), and the drift so far."""
        new = self.entries.copy()
        for p in range(self.parts):
            used = counts[:, p] > 0
            new[used, self.part(p)] = sums[used, self.part(p)] // counts[used, p, None]
        out = Codebooks(new, self.parts)
        for p in range(self.parts):
            way = np.sqrt(((new[:, self.part(p)] - self.entries[:, self.part(p)]) ** 2).sum(1).astype(float))
            others = np.array([np.delete(way, e).max(initial=0) for e in range(len(way))])
            out.drift[p] = np.minimum(self.drift[p] + np.ceil((way + others) * FINE).astype(np.int64) + 1, _FAR)
        return out

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, as decimal text joined by commas."""
        return hashlib.sha256(",".join(str(v) for p in range(self.parts) for v in self.entries[:, self.part(p)].ravel().tolist()).encode()).hexdigest()


class Heaps:
    """A block's heaps: for part p and entry e the items from offset p * entries + e, in heap order."""

    def __init__(self, items: np.ndarray, sizes: np.ndarray):
        self.items, self.sizes = items, sizes

    @classmethod
    def of(cls, codes: np.ndarray, gaps: np.ndarray, books: Codebooks) -> Heaps:
        """Heaps of all parts of a block (rows by parts); a sorted list is a heap."""
        n, (parts, entries) = len(codes), books.drift.shape
        slot = (np.arange(parts)[None] * entries + codes).ravel()
        items = ((gaps + books.drift[np.arange(parts)[None], codes]) << ROW_BITS).ravel() + np.repeat(np.arange(n), parts)
        order = np.lexsort((items, slot))
        return cls(items[order], np.bincount(slot, minlength=parts * entries))

    def popped(self, x: np.ndarray, codes: np.ndarray, books: Codebooks) -> int:
        """Pop the parts that the drift has reached, rescan them, and put them into their entries' heaps; ``codes`` changes with them.

        Returns how many parts were rescanned.
        """
        from heapq import heappop, heappush

        entries, ends = books.drift.shape[1], np.cumsum(self.sizes)
        starts, limit = ends - self.sizes, (books.drift.ravel() + 1) << ROW_BITS  # an item below has a key of at most the drift
        some = np.flatnonzero(self.sizes)
        touched = some[self.items[starts[some]] < limit[some]]
        heaps, rows = {}, {}
        for s in touched.tolist():
            heap, most = self.items[starts[s] : ends[s]].tolist(), int(limit[s])
            gone = rows.setdefault(s // entries, [])
            while heap and heap[0] < most:
                gone.append(heappop(heap) & (1 << ROW_BITS) - 1)
            heaps[s] = heap
        for p, gone in rows.items():
            a, gap = books.nearest(x[gone], p)
            codes[gone, p] = a
            for e, key, row in zip(a.tolist(), (gap + books.drift[p, a]).tolist(), gone, strict=True):
                s = p * entries + e
                if s not in heaps:
                    heaps[s] = self.items[starts[s] : ends[s]].tolist()
                heappush(heaps[s], key << ROW_BITS | row)
        if heaps:
            same = [self.items[starts[s] : ends[s]] if s not in heaps else np.array(heaps[s], np.int64) for s in range(len(self.sizes))]
            self.items, self.sizes = np.concatenate(same), np.array([len(h) for h in same])
        return sum(map(len, rows.values()))


def _summed(total: np.ndarray, x: np.ndarray, codes: np.ndarray, books: Codebooks, sign: int = 1) -> None:
    """Add (or take off) parts to the sums (entries by components, then by part: the counts)."""
    width = x.shape[1]
    for p in range(books.parts):
        here = codes[:, p] >= 0
        np.add.at(total[:, books.part(p)], codes[here, p], sign * x[here, books.part(p)].astype(np.int64))
        total[:, width + p] += sign * np.bincount(codes[here, p], minlength=len(total))


_BLOCK = (("_codes", T.BinaryType()), ("_heaps", T.BinaryType()), ("_sizes", T.BinaryType()), ("_sums", T.BinaryType()), ("_scans", T.LongType()))


def _state(ids: T.DataType, labels: T.DataType) -> T.StructType:
    """Blocks, and a last row per task that has the sums, or what changed them, and the number of parts scanned."""
    return T.StructType([T.StructField("_id", T.ArrayType(ids)), T.StructField("_l", T.ArrayType(labels)), T.StructField("_x", T.BinaryType()), *(T.StructField(*f) for f in _BLOCK)])


def _listed(column):
    """Arrow values as one list."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def _row(schema, **values):
    """One Arrow row; what is not given is null."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([values[n] if n in values and not isinstance(values[n], (bytes, int)) else pa.array([values.get(n)], t) for n, t in schema], [n for n, _ in schema])


def first_round(rows: DataFrame, books: Codebooks) -> DataFrame:
    """Blocks of ``kept`` rows, as long as the codebooks' entries, with every part scanned."""
    ids, labels = rows.schema["_id"].dataType, rows.schema["_l"].dataType
    width = books.entries.shape[1]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, scans, schema = np.zeros((len(books.entries), width + books.parts), np.int64), 0, None
        for b in slices(batches, BLOCK_ROWS, BLOCK_BYTES):
            schema = schema or [("_id", pa.list_(b.schema.field(0).type)), ("_l", pa.list_(b.schema.field(1).type)), ("_x", pa.binary()), ("_codes", pa.binary()), ("_heaps", pa.binary()), ("_sizes", pa.binary()), ("_sums", pa.binary()), ("_scans", pa.int64())]
            x = whole(b.column(2).flatten().to_numpy(zero_copy_only=False)).reshape(b.num_rows, width)
            codes, gaps = np.zeros((len(x), books.parts), np.int64), np.zeros((len(x), books.parts), np.int64)
            for p in range(books.parts):
                codes[:, p], gaps[:, p] = books.nearest(x, p)
            scans += codes.size
            heaps = Heaps.of(codes, gaps, books)
            _summed(total, x, codes, books)
            yield _row(schema, _id=_listed(b.column(0)), _l=_listed(b.column(1)), _x=x.tobytes(), _codes=codes.astype(np.uint8).tobytes(), _heaps=heaps.items.tobytes(), _sizes=heaps.sizes.astype(np.int32).tobytes())
        if schema:
            yield _row(schema, _sums=total.tobytes(), _scans=scans)

    return mapped(rows, run, _state(ids, labels))


def _blocks(batches: Iterator, books: Codebooks) -> Iterator:
    width = books.entries.shape[1]
    for b in batches:
        for i in range(b.num_rows):
            own = b.slice(i, 1)
            x, codes, items, sizes = (np.frombuffer(own.column(n)[0].as_py(), t) for n, t in (("_x", np.int32), ("_codes", np.uint8), ("_heaps", np.int64), ("_sizes", np.int32)))
            codes = codes.reshape(-1, books.parts).astype(np.int64)
            yield own, x.reshape(len(codes), width), codes, Heaps(items, sizes.astype(np.int64))


def next_round(state: DataFrame, books: Codebooks) -> DataFrame:
    """Blocks after the entries' move: popped parts are rescanned, and sums are of the parts that changed their entry."""
    width = books.entries.shape[1]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        change, scans, schema = np.zeros((len(books.entries), width + books.parts), np.int64), 0, None
        for own, x, codes, heaps in _blocks(batches, books):
            schema = schema or [(f.name, f.type) for f in own.schema] + [("_sums", pa.binary()), ("_scans", pa.int64())]
            before = codes.copy()
            scans += heaps.popped(x, codes, books)
            same = before == codes
            _summed(change, x, np.where(same, -1, before), books, -1)
            _summed(change, x, np.where(same, -1, codes), books)
            yield _row(schema, _id=own.column("_id"), _l=own.column("_l"), _x=own.column("_x"), _codes=codes.astype(np.uint8).tobytes(), _heaps=heaps.items.tobytes(), _sizes=heaps.sizes.astype(np.int32).tobytes())
        if schema:
            yield _row(schema, _sums=change.tobytes(), _scans=scans)

    blocks = state.where(F.col("_x").isNotNull()).drop("_sums", "_scans")
    return mapped(blocks, run, state.schema)


def coded(state: DataFrame, books: Codebooks) -> DataFrame:
    """_id, _l, code and error of every vector, after a last pop of what the entries' last move may have changed."""
    ids, labels = state.schema["_id"].dataType.elementType, state.schema["_l"].dataType.elementType

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for own, x, codes, heaps in _blocks(batches, books):
            heaps.popped(x, codes, books)
            error = np.zeros(len(x), np.int64)
            for p in range(books.parts):
                error += ((x[:, books.part(p)] - books.entries[codes[:, p], books.part(p)]) ** 2).sum(1)
            text = codes.astype(np.uint8).tobytes().hex()
            step = 2 * books.parts
            names = [text[i : i + step] for i in range(0, len(text), step)]
            yield pa.RecordBatch.from_arrays([own.column("_id").flatten(), own.column("_l").flatten(), pa.array(names, pa.string()), pa.array(error, pa.int64())], ["_id", "_l", "code", "error"])

    schema = T.StructType([T.StructField("_id", ids), T.StructField("_l", labels), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return mapped(state.where(F.col("_x").isNotNull()).drop("_sums", "_scans"), run, schema)


def sums(state: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The tasks' sums added up: as many numbers as the codebooks have, and the counts, whatever the rows."""

    def numbers(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = None
        for b in batches:
            for v in b.column(0).to_pylist():
                x = np.frombuffer(v, np.int64)
                total = x if total is None else total + x
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["i", "v"])

    parts = mapped(state.select("_sums").where(F.col("_sums").isNotNull()), numbers, "i int, v long")
    out = np.zeros(shape[0] * shape[1], np.int64)
    for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out.reshape(shape)


def compress(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks, list[DataFrame]]:
    """_id, _l, code and error of every kept vector (a written table), the final codebooks, and the rounds' states (written).

    The first entries are the vectors of the smallest ids (a null id is the largest; of equal ids the smaller
    vector). With fewer vectors than ``entries`` there are so many entries. What the driver gets is the first
    entries and sums of the codebooks' size.
    """
    rows = kept(df, vector, vec_id, label)
    in_order = [F.asc_nulls_last("_id"), "_x"]
    first = [len(r["_x"]) for r in rows.orderBy(*in_order).limit(1).collect()]
    width = first[0] if first else 0
    rows = rows.where(F.size("_x") == width)
    start = [whole(np.array(r["_x"])) for r in rows.orderBy(*in_order).limit(entries).collect()]
    books = Codebooks(np.array(start).reshape(len(start), width), parts)
    shape = (len(books.entries), books.entries.shape[1] + parts)
    if not start:
        schema = T.StructType([rows.schema["_id"], rows.schema["_l"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
        return df.sparkSession.createDataFrame([], schema), books, []
    states, total = [], np.zeros(shape, np.int64)
    for i in range(rounds):
        states.append(written(next_round(states[-1], books) if i else first_round(rows, books)))
        total = total + sums(states[-1], shape)
        books = books.moved(total[:, : shape[1] - parts], total[:, shape[1] - parts :])
    return written(coded(states[-1], books)), books, states


def op13_heap_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings in codebooks of 64 entries for 16 parts, after two rounds.

    Vectors that are null or hold null or non-finite components are dropped, and so are those of another length
    than the vector of the smallest id, to which no distance exists. Repeated rows have a row each; null labels are
    equal; a sum of errors beyond long is null; an empty table gives no rows.
    """
    out, books, states = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    dropped(*states)
    total = out.groupBy(F.col("_l").alias("_same")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    both = out.join(total, out["_l"].eqNullSafe(total["_same"]))
    return both.select(F.col("_id").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    ctes = [
        """kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
 FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"parts AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS s FROM kept, range({PARTS}) AS t(p))",
        f"c0 AS (SELECT p, r - 1 AS e, s FROM parts WHERE r <= {ENTRIES})",
    ]
    for i in range(ROUNDS + 1):
        # of equal distances the lower entry: one number holds both
        ctes.append(f"""a{i} AS MATERIALIZED (SELECT r, p, CAST(m % {ENTRIES} AS INTEGER) AS e, m // {ENTRIES} AS d FROM (
 SELECT r, parts.p, min({ENTRIES} * CAST(list_dot_product(parts.s, parts.s) - 2 * list_dot_product(parts.s, c.s) + list_dot_product(c.s, c.s) AS BIGINT) + e) AS m FROM parts JOIN c{i} c ON parts.p = c.p GROUP BY r, parts.p))""")
        if i < ROUNDS:
            ctes.append(f"""m{i} AS (SELECT p, e, list(CAST((t - ((t % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS s FROM (
 SELECT p, e, i, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM (SELECT parts.p, e, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM parts JOIN a{i} USING (r, p)) GROUP BY p, e, i) GROUP BY p, e)""")
            ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.s, c.s) AS s FROM c{i} c LEFT JOIN m{i} m USING (p, e))")
    ctes.append(f"codes AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)")
    ctes.append(f"book AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM c{ROUNDS}))")
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes JOIN kept USING (r), book"


OP13_SQL = _sql()
