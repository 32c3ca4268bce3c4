"""Packing documents into windows by Karmarkar-Karp multiway differencing.

A document's ids (with the end id) are cut into windows of full capacity; the rest, if long, is halved
until no piece exceeds ``max_piece``. The pieces of a group are then dealt to k windows at once: each
piece begins as a partition with one loaded window and k - 1 empty ones, and the two partitions with
the largest differences are merged, the fullest windows of the one with the emptiest of the other,
until one partition is left. k begins at the least that could hold the pieces; when a window exceeds
the capacity, k rises and the group is dealt again.

Groups are runs of an input partition, so packing needs no shuffle and holds one group in memory; it
repeats exactly when a lost partition is read again. Partitions of few rows are joined first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.batches import filled, mapped, slices
from tarmac.llm.tokens import END_ID, pieces, tokenizer_path

CAPACITY = 2048
#: Pieces differenced together, and the longest piece that is not a whole window.
GROUP, MAX_PIECE = 1024, 512
#: Rows of a partition, at least on average: smaller partitions are joined, so that few groups are small.
LEAST_ROWS = 512

#: Bits of a node's number.
_NODE = 40

#: The columns beside doc_id, which has the type of the ids.
SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def differenced(sizes: list[int], k: int) -> list[list[int]]:
    """The indexes of ``sizes`` in k windows of near-equal sums.

    A partition is kept as its loaded windows only, in rising order; those not listed are empty. A window is
    one number: its load, and below it the node of a tree whose leaves are the pieces.
    """
    n = len(sizes)
    if not n:
        return [[] for _ in range(k)]
    low = (1 << _NODE) - 1
    joined: list[tuple[int, int]] = []
    heap = [(-x if k > 1 else 0, i, [x << _NODE | i]) for i, x in enumerate(sizes)]
    heapq.heapify(heap)
    for at in range(n, 2 * n - 1):
        a = heapq.heappop(heap)[2]
        b = heapq.heappop(heap)[2]
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:
            # opposite ends: the emptiest windows of the one meet the fullest of the other
            merged = a[over:] + b[over:]
            for x, y in zip(a[:over], reversed(b[:over])):
                merged.append((x >> _NODE) + (y >> _NODE) << _NODE | n + len(joined))
                joined.append((x & low, y & low))
        merged.sort()
        least = merged[0] >> _NODE if len(merged) == k else 0
        heapq.heappush(heap, (least - (merged[-1] >> _NODE), at, merged))
    out = []
    for w in heap[0][2]:
        own, open_nodes = [], [w & low]
        while open_nodes:
            node = open_nodes.pop()
            if node < n:
                own.append(node)
            else:
                open_nodes += joined[node - n]
        out.append(own)
    return out + [[] for _ in range(k - len(out))]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """``differenced`` over the least k, raised for as long as a window exceeds the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differenced(sizes, k)
        most = max(sum(sizes[i] for i in w) for w in found)
        if most <= capacity:
            return [w for w in found if w]
        k += max(1, k * (most - capacity) // (8 * capacity))


def cuts(n: int, capacity: int, max_piece: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: full windows, then near-equal pieces of the rest."""
    out = [(s, capacity) for s in range(0, n - capacity + 1, capacity)]
    at, rest = len(out) * capacity, n - len(out) * capacity
    if rest:
        parts = -(-rest // max_piece)
        edges = [rest * j // parts for j in range(parts + 1)]
        out += [(at + a, b - a) for a, b in zip(edges, edges[1:])]
    return out


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group: int = GROUP, max_piece: int = MAX_PIECE, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (uint32 little-endian bytes), doc_tokens, sequence_id, offset.

    Whole texts are encoded; a null or empty text is the end id alone. Each id of a document lies in
    exactly one piece, and the pieces of a sequence fill its offsets from 0 without gaps. Ids may be
    null, repeat and have any type: rows are packed as they come. Other columns of ``df`` are ignored. An empty table
    gives no rows.
    """
    path = path or tokenizer_path()
    end = END_ID.to_bytes(4, "little")
    max_piece = min(max_piece, capacity)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encode = pieces(path).ids
        base, number = TaskContext.get().partitionId() << 40, 0
        rows: list[tuple] = []
        held: list[tuple] = []
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        types = [None, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        nbytes = 0

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
            rows.clear()
            return out

        def deal() -> None:
            nonlocal number
            for w in windows([h[2] for h in held], capacity):
                at = 0
                for i in w:
                    rows.append((*held[i], base + number, at))
                    at += held[i][2]
                number += 1
            held.clear()

        for b in slices(batches):
            types[0] = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                nbytes += len(ids)
                for start, length in cuts(n, capacity, max_piece):
                    piece = (doc, start, length, ids[4 * start : 4 * (start + length)], n)
                    if length == capacity:
                        rows.append((*piece, base + number, 0))
                        number += 1
                    else:
                        held.append(piece)
                if len(held) >= group:
                    deal()
                if nbytes > 8_000_000:
                    nbytes = 0
                    yield batch()
        if held:
            deal()
        if types[0] is not None:
            yield batch()

    rows = filled(df, LEAST_ROWS).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(rows, run, T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(SCHEMA)]))


def op7_differencing_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 ids; the ids of each piece as a checksum."""
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
