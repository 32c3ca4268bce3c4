"""Token-id rows by best-fit-decreasing packing with a capacity search in a segment tree.

A document of more ids than a row is split into full rows and a rest, without loss. The rests of a group
are taken in falling length; each goes to the row whose free space fits it most closely. Rows are
found by their free space: the leaves of a segment tree count the rows of each free space, and the search
goes to the leftmost leaf at or right of the length that is not empty.

Groups are runs of an input partition, so there is no shuffle, and a lost partition is made again alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.batches import filled, mapped, slices
from tarmac.llm.storage import shared_dir
from tarmac.llm.tokens import END_ID, pieces, tokenizer_path

CAPACITY, GROUP, PAD_ID = 2048, 2048, 0
#: Rows of a partition, at least on average: smaller partitions are joined, so that few groups are small.
LEAST_ROWS = 512
#: The columns beside doc_ids, whose type is that of the ids.
SCHEMA = "row_id long, n_ids int, ids binary, positions binary, cu_seqlens array<int>, starts array<long>"


class FreeSpace:
    """Rows by their free space, from 0 to ``capacity``."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        i = free + self.leaves
        while i:
            self.counts[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(free space, row) of the tightest row with at least ``least``, taken out; None if there is none."""
        i = least + self.leaves
        while not self.counts[i]:
            # up until a subtree to the right is not empty
            while i & 1:
                i >>= 1
            if i == 0:
                return None
            i += 1
        while i < self.leaves:
            i *= 2
            if not self.counts[i]:
                i += 1
        free = i - self.leaves
        row = self.rows[free].pop()
        while i:
            self.counts[i] -= 1
            i >>= 1
        return free, row


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """The indexes of ``sizes`` (none over the capacity) by row, in falling size."""
    space, rows = FreeSpace(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = space.take(sizes[i])
        if found is None:
            rows.append([i])
            free, row = capacity, len(rows) - 1
        else:
            free, row = found
            rows[row].append(i)
        if free > sizes[i]:
            space.put(free - sizes[i], row)
    return rows


def token_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group: int = GROUP, path: str | None = None) -> DataFrame:
    """Rows of ``capacity`` ids for a matrix on disk.

    ids: uint32 little-endian, filled up with ``PAD_ID``; positions: uint16 (uint32 beyond 65,536 ids),
    from 0 at each segment; cu_seqlens: 0 and the ends of the segments; doc_ids and starts: each segment's
    document and where in that document's ids it begins. A null or empty text is its end id alone. Ids may
    be null, repeat and have any type. Other columns are ignored, and an empty table gives no rows.
    """
    path = path or tokenizer_path()
    end = END_ID.to_bytes(4, "little")
    width = "<u2" if capacity <= 1 << 16 else "<u4"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode = pieces(path).ids
        number = TaskContext.get().partitionId() << 40
        count = np.arange(capacity).astype(width)
        names = ["row_id", "n_ids", "ids", "positions", "cu_seqlens", "doc_ids", "starts"]
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), None, pa.list_(pa.int64())]
        rows: list[tuple] = []
        held: list[tuple] = []
        whole = count.tobytes()

        def add(segments: list[tuple]) -> None:
            nonlocal number
            cu = [0]
            for _, _, ids in segments:
                cu.append(cu[-1] + len(ids) // 4)
            fill = capacity - cu[-1]
            if len(segments) == 1 and not fill:
                positions = whole
            else:
                positions = b"".join([whole[: (b - a) * count.itemsize] for a, b in zip(cu, cu[1:])] + [bytes(fill * count.itemsize)])
            ids = b"".join([s[2] for s in segments] + [PAD_ID.to_bytes(4, "little") * fill])
            rows.append((number, cu[-1], ids, positions, cu, [s[0] for s in segments], [s[1] for s in segments]))
            number += 1

        def deal() -> None:
            for own in best_fit([len(h[2]) // 4 for h in held], capacity):
                add([held[i] for i in own])
            held.clear()

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
            rows.clear()
            return out

        for b in slices(batches):
            types[5] = pa.list_(b.schema.field(0).type)
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    segment = (doc, s, ids[4 * s : 4 * (s + capacity)])
                    if n - s >= capacity:
                        add([segment])
                    else:
                        held.append(segment)
                if len(held) >= group:
                    deal()
                if len(rows) >= 1000:
                    yield batch()
        deal()
        if types[5] is not None:
            yield batch()

    texts = filled(df, LEAST_ROWS).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = T.StructType.fromDDL(SCHEMA).fields
    return mapped(texts, run, T.StructType([*fields[:5], T.StructField("doc_ids", T.ArrayType(texts.schema["doc_id"].dataType)), *fields[5:]]))


def write_rows(rows: DataFrame, path: str) -> DataFrame:
    """Write rows of ``token_rows`` as Parquet in zstd, whose binary columns are the matrices row by row, and return a reader of them."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def op3_best_fit_token_rows(spark, sf_dir: str) -> DataFrame:
    """All documents written in rows of 2048 ids and read back: what each row holds, and checksums of its ids and positions."""
    rows = token_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = write_rows(rows, f"{shared_dir(spark)}/tarmac-rows-{uuid.uuid4().hex}")
    return rows.select("row_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"), "cu_seqlens", "doc_ids", "starts")
