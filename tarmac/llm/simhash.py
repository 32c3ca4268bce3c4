"""SimHash near-duplicates by tables of distances to reference fingerprints.

Of two fingerprints within r bits of each other, no distance to any reference differs by more than r (triangle
inequality). The references are of two kinds. The zero fingerprint with those of a single bit: the differences
between their distances, within a block of bits, are the block's bits, so of m blocks all but r have equal
differences for a linked pair. Any m - r blocks of equal differences make a cell, and each linked pair shares
a cell. The others are drawn from a seed: their distances are precomputed for each fingerprint and travel with
it. In a cell rows are sorted by the first distance, pairs are those within r of each other there, each further
distance discards, and what survives is verified bit by bit. A cell that holds too many fingerprints is divided
by its first distances, and only divisions within r of each other meet.

Only links that join what the task has not joined yet are kept, so links grow with the fingerprints, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.batches import mapped, slices
from tarmac.llm.components import components
from tarmac.llm.storage import dropped, written

BITS, RADIUS, WORDS, SEED = 64, 3, 3, 42
#: Drawn references; their seed.
REFERENCES, DRAWN = 16, 12
#: Fingerprints of a division of a cell, on average; fingerprints for each value of a cell's bits, on average.
DIVISION, CELL = 1024, 64
#: Rows of cells that are put together before their pairs are looked at.
ROWS = 1 << 16


def simhash(text: str | None) -> int:
    """The fingerprint of a whole text: a bit is 1 where over half of its shingles' XXH64 have it. No words: 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and the six blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    n = max(1, len(words) - WORDS + 1)
    stops = (ends[min(WORDS, len(words)) - 1 :] - 1).tolist()
    h, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for lo in range(0, n, ROWS):  # a very long text takes little memory
        some = np.array([h(joined[a:b], SEED) for a, b in zip(starts[lo : lo + ROWS], stops[lo : lo + ROWS], strict=False)], dtype="<u8")
        total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """_id (of the id's own type) and _f (the fingerprint as a signed long) of every row; a null text has none of words, and 0."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches):
            made = np.array([simhash(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.int64())], ["_id", "_f"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_t"))
    return mapped(rows, run, T.StructType([T.StructField("_id", rows.schema["_id"].dataType), T.StructField("_f", T.LongType())]))


def references(n: int = REFERENCES, seed: int = DRAWN) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, np.uint64)


def blocks_of(n: int, radius: int = RADIUS) -> list[int]:
    """Widths of the blocks for ``n`` fingerprints: the fewest with which a value of radius-fewer blocks has ``CELL`` of them at most."""
    for m in range(radius + 1, 4 * radius + 1):
        widths = [len(x) for x in np.array_split(np.arange(BITS), m)]
        if n <= CELL << sum(sorted(widths)[: m - radius]):
            break
    return widths


def celled(table: DataFrame, widths: list[int], radius: int = RADIUS) -> DataFrame:
    """``table`` (_f, _first, _d) with a row for each cell of a fingerprint: _c, the values of m - radius of its blocks and which they are."""
    starts = np.concatenate([[0], np.cumsum(widths)]).astype(int)
    cells = []
    for i, picked in enumerate(combinations(range(len(widths)), len(widths) - radius)):
        value = F.lit(i).cast("long")
        for j in picked:
            value = F.shiftleft(value, widths[j]).bitwiseOR(F.shiftrightunsigned("_f", int(starts[j])).bitwiseAND(F.lit((1 << widths[j]) - 1).cast("long")))
        cells.append(value)
    return table.select(F.explode(F.array(*cells)).alias("_c"), "_f", "_first", "_d")


def with_distances(prints: DataFrame) -> DataFrame:
    """The distance table: _f, _first (its distance to the first drawn reference), and _d: a byte for the distance to each."""
    far = [F.bit_count(F.col("_f").bitwiseXOR(F.lit(int(np.uint64(r).view(np.int64))).cast("long"))) for r in references()]
    return prints.select("_f", far[0].cast("int").alias("_first"), F.unhex(F.concat(*[F.lpad(F.hex(d.cast("long")), 2, "0") for d in far])).alias("_d"))


def divided(cells: DataFrame, radius: int = RADIUS) -> DataFrame:
    """_k (what meets), _first (its first distance), _f, _d: cells, and large ones as pairs of divisions.

    A cell of more than twice ``DIVISION`` fingerprints is cut by first distance, and each distance by a hash;
    each two divisions within ``radius`` meet under a key of their own. What decides is how many rows a cell has
    at each distance: one small row for a large cell's distances, grouped and joined, not collected.
    """
    counts = cells.groupBy("_c", "_first").agg(F.count("*").alias("_n")).groupBy("_c").agg(F.sum("_n").alias("_all"), F.map_from_entries(F.collect_list(F.struct("_first", F.ceil(F.col("_n") / DIVISION).cast("int")))).alias("_parts"))
    large = counts.where(F.col("_all") > 2 * DIVISION).select("_c", "_parts")
    both = cells.join(large, "_c", "left")
    small = F.array(F.xxhash64(F.col("_c"), F.lit(0)))
    own = F.pmod(F.xxhash64(F.col("_f"), F.lit(1)), F.element_at("_parts", F.col("_first"))).cast("int")
    # (distance, part) of each division that this one meets, itself included
    met = F.flatten(F.transform(F.map_entries(F.map_filter("_parts", lambda d, n: F.abs(d - F.col("_first")) <= radius)), lambda e: F.transform(F.sequence(F.lit(0), e["value"] - 1), lambda p: e["key"] * (1 << 24) + p)))
    mine = F.col("_first") * (1 << 24) + own
    pairs = F.transform(met, lambda o: F.xxhash64(F.col("_c"), F.least(o, mine), F.greatest(o, mine)))
    return both.select(F.explode(F.when(F.col("_parts").isNull(), small).otherwise(pairs)).alias("_k"), "_first", "_f", "_d")


def _roots(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links (x, y): as many links as join the same values, each from a value to the least that it reaches."""
    names, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = ends[: len(x)], ends[len(x) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def linked(key: np.ndarray, f: np.ndarray, d: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, int]:
    """Links of rows sorted by key and first distance, and how many pairs were verified.

    Row i meets row i + 1, i + 2, ... for all i at once; a row stops where the key ends or the first distance
    is more than ``radius`` away. Equal fingerprints are met, and joined, like others.
    """
    own, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    u, at, verified, held = f.view(np.uint64), np.arange(len(f) - 1), 0, 0
    step = 1
    while len(at):
        at = at[at + step < len(f)]
        at = at[(key[at] == key[at + step]) & (d[at + step, 0] - d[at, 0] <= radius)]
        left = at
        for j in range(1, d.shape[1]):
            left = left[np.abs(d[left, j] - d[left + step, j]) <= radius]
        verified += len(left)
        left = left[np.bitwise_count(u[left] ^ u[left + step]) <= radius]
        if len(left):
            own.append(f[left])
            other.append(f[left + step])
            held += len(left)
        if held > 4 * len(f):
            x, y = _roots(np.concatenate(own), np.concatenate(other))
            own, other, held = [x], [y], len(x)
        step += 1
    x, y = _roots(np.concatenate(own), np.concatenate(other))
    return x, y, verified


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b (long): fingerprints within ``radius`` of each other, as many links as keep all groups together."""
    n = prints.count()
    rows = divided(celled(with_distances(prints), blocks_of(n, radius), radius), radius)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, rows = [], 0

        def found(parts: list, whole: bool):
            """Links of all but the last key, unless ``whole``; what is left."""
            b = pa.Table.from_batches(parts).combine_chunks()
            key = b.column("_k").to_numpy()
            cut = len(key) if whole else int(np.searchsorted(key, key[-1]))
            if cut:
                f = b.column("_f").slice(0, cut).to_numpy()
                d = np.frombuffer(b"".join(b.column("_d").slice(0, cut).to_pylist()), np.uint8).reshape(cut, -1).astype(np.int16)
                x, y, _ = linked(key[:cut], f, d, radius)
                made = [pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])]
            else:
                made = []
            return made, b.slice(cut).to_batches(), len(key) - cut

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= ROWS:
                made, held, rows = found(held, False)
                yield from made
        if rows:
            yield from found(held, True)[0]

    by_key = rows.repartition("_k").sortWithinPartitions("_k", "_first")
    return mapped(by_key, run, "a long, b long")


def near_groups(prints: DataFrame) -> DataFrame:
    """_f and _least (the smallest _id reachable; null if there are no others) for every fingerprint of ``prints`` (_id, _f).

    Equal fingerprints are one vertex, whatever their number.
    """
    alone = written(prints.groupBy("_f").agg(F.min("_id").alias("_id")))
    found = written(links(alone.select("_f")))
    reached = components(found)
    named = alone.join(reached, F.col("_f") == F.col("v"), "left").select("_f", "_id", F.coalesce("c", "_f").alias("_c"))
    least = named.groupBy("_c").agg(F.min("_id").alias("_least"))
    out = written(named.join(least, "_c").select("_f", "_least"))
    dropped(alone, found, reached)
    return out


def op12_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest document id that links of at most 3 bits lead to.

    Null and empty texts have fingerprint 0 and are linked like others; null ids are linked but never the
    smallest, unless there is no other; repeated rows have a row each; an empty table gives no rows.
    """
    docs = written(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    groups = near_groups(docs)
    out = docs.join(groups, "_f")
    return out.select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_f"), 16, "0")).alias("fingerprint"), F.col("_least").alias("component_id"))
