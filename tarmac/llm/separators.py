"""Token counts of documents in flat, unindexed token files by a scan for end-of-document ids.

A file is a run of ids with an end id behind each document. Ranges of it are read by different tasks, and
blocks are searched on their own, a whole block in one vector comparison; a document that begins in one block
and ends in another is put together from what the blocks before it have counted. Those sums over blocks (ids,
ends, the last end) are associative, so they are a prefix scan: within spans of blocks, then over the spans.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.batches import mapped, slices
from tarmac.llm.storage import deleted, shared_dir, written
from tarmac.llm.tokens import pieces, tokenizer_path
from tarmac.sources.files import OPENED, qualified, store_of

#: The vocabulary's end-of-text id, which no text is encoded to; bytes of an id and of a block; blocks of a span.
END_ID, WIDTH, BLOCK_BYTES, SPAN_BLOCKS = 49407, 2, 1 << 18, 256
#: Stores whose files tasks can open at an offset; files elsewhere are read whole.
RANGED = OPENED


def write_token_files(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, width: int = WIDTH, tokenizer: str | None = None) -> DataFrame:
    """Write each partition's ids as one flat file under ``path`` (in the session's default store where it names none), and return file (its name), doc_no (from 0) and the id of each document.

    A null or empty text is its end id alone; ids may be null, repeat and have any type. The rows returned are of a
    written table: they name only files of tasks that succeeded, and files that a lost or repeated task left are named nowhere.
    """
    tokenizer, path = tokenizer or tokenizer_path(), qualified(df.sparkSession, path)
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("doc_no", T.LongType()), T.StructField("doc_id", df.schema[id_col].dataType)])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        system, folder = store_of(path)
        encode, end = pieces(tokenizer).ids, end_id.to_bytes(width, "little")
        name, out, n = f"{uuid.uuid4().hex}.bin", None, 0
        try:
            for b in slices(batches):
                if out is None:
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(f"{folder}/{name}", buffer_size=1 << 20)
                for text in b.column(1).to_pylist():
                    out.write(np.frombuffer(encode(text), "<u4").astype(f"<u{width}").tobytes() + end)
                yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows), pa.array(range(n, n + b.num_rows), pa.int64()), b.column(0)], ["file", "doc_no", "doc_id"])
                n += b.num_rows
        finally:
            if out is not None:
                out.close()

    return written(mapped(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema))


def read_token_files(spark: SparkSession, path: str, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, span_blocks: int = SPAN_BLOCKS, names: DataFrame | None = None) -> DataFrame:
    """file, block, data: the flat files under a path in blocks; only those whose last part of the path is in ``names`` (a column ``file``), if given.

    Blocks hold whole ids; bytes behind a file's last whole id are in its last block. Ranges of ``span_blocks`` blocks
    are spread over tasks, so a file can have any size. In a store that is not of ``RANGED`` a file is read whole (2^31 bytes at most).
    """
    size = block_bytes // width * width
    files = spark.read.format("binaryFile").load(path).withColumnRenamed("path", "file")
    if names is not None:
        files = files.join(names.select(F.col("file").alias("_name")).distinct(), F.element_at(F.split("file", "/"), -1) == F.col("_name"), "left_semi")
    found = files.agg(F.collect_set(F.split("file", ":")[0]).alias("schemes"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    last = F.greatest(F.col("length") - 1, F.lit(0).cast("long"))
    if not set(found["schemes"]) <= RANGED:
        cut = files.select("file", "content", "length", F.posexplode(F.sequence(F.lit(0).cast("long"), last, F.lit(size).cast("long"))).alias("block", "_at"))
        return cut.select("file", F.col("block").cast("long").alias("block"), F.expr(f"substring(content, int(_at) + 1, int(least({size}L, length - _at)))").alias("data"))
    span = size * span_blocks
    ranges = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(span).cast("long"))).alias("at"))
    parts = max(1, min(found["bytes"] // span + 1, 1 << 20), spark.sparkContext.defaultParallelism if found["bytes"] > size else 1)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for file, length, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                system, where = store_of(file)
                with system.open_input_file(where) as f:
                    f.seek(at)
                    for lo in range(at, max(min(at + span, length), at + 1), size):
                        data = f.read(min(size, length - lo))
                        if len(data) != min(size, length - lo):
                            raise EOFError(f"{file} is shorter than {length} bytes")
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([lo // size], pa.int64()), pa.array([data], pa.binary())], ["file", "block", "data"])

    return mapped(ranges.repartition(parts), run, "file string, block long, data binary")


def separator_scan(blocks: DataFrame, end_id: int = END_ID, width: int = WIDTH, span_blocks: int = SPAN_BLOCKS) -> DataFrame:
    """file, doc_no (from 0), start, n_tokens (without the end id), ended, cut_bytes: one row per document of each file.

    ``blocks`` has file, block (in order, any whole numbers) and data; a null or empty block holds nothing, and other
    columns are ignored. Ids behind the last end are a document with ended = false. A document of no ids counts 0.
    ``cut_bytes`` is how many bytes of the file make no whole id (0 unless it is damaged); they are in no document.
    The positions of ends are written to the shared folder, so that blocks are read once.
    """
    names = ["file", "block", "_n", "_rest", "_k", "_tail", "_ends"]
    schema = T.StructType([blocks.schema["file"], T.StructField("block", T.LongType()), *(T.StructField(c, T.LongType()) for c in names[2:6]), T.StructField("_ends", T.ArrayType(T.LongType()))])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            rows, ends = [], []
            for value in b.column(2):
                raw = value.as_buffer()
                n, rest = divmod(len(raw) if raw is not None else 0, width)
                ends.append(np.flatnonzero(np.frombuffer(raw, f"<u{width}", count=n) == end_id) if n else np.zeros(0, np.int64))
                rows.append((n, rest, len(ends[-1]), ends[-1][-1] if len(ends[-1]) else None))
            offsets = np.concatenate([[0], np.cumsum([len(e) for e in ends])]).astype(np.int32)
            flat = np.concatenate(ends) if ends else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))
            numbers = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *numbers, lists], names)

    scanned = written(mapped(blocks.select("file", F.col("block").cast("long").alias("block"), "data"), run, schema))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")

    def within(table: DataFrame) -> DataFrame:
        """Ids, ends and the last end before each block, in its span."""
        own = before.partitionBy("file", "_span").orderBy("block")
        table = table.withColumn("_span", F.expr(f"block div {span_blocks}")).withColumn("_base", F.coalesce(F.sum("_n").over(own), none))
        return table.withColumn("_no", F.coalesce(F.sum("_k").over(own), none)).withColumn("_carry", F.max(F.col("_base") + F.col("_tail")).over(own))

    sums = within(scanned.drop("_ends")).groupBy("file", "_span").agg(F.sum("_n").alias("_n"), F.sum("_k").alias("_k"), F.sum("_rest").alias("_rest"), F.max(F.col("_base") + F.col("_tail")).alias("_tail"))
    earlier, every = before.partitionBy("file").orderBy("_span"), Window.partitionBy("file")
    sums = sums.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), none))
    last = F.col("_base") + F.col("_tail")
    spans = sums.select(
        F.col("file").alias("_f"), F.col("_span").alias("_s"), F.col("_base").alias("_s_base"),
        F.coalesce(F.sum("_k").over(earlier), none).alias("_s_no"), F.coalesce(F.max(last).over(earlier), F.lit(-1).cast("long")).alias("_s_carry"),
        F.sum("_n").over(every).alias("_all"), (F.coalesce(F.max(last).over(every), F.lit(-1).cast("long")) + 1).alias("_over"), F.sum("_rest").over(every).alias("cut_bytes"),
    )
    rows = within(scanned).join(spans, F.col("file").eqNullSafe(F.col("_f")) & (F.col("_span") == F.col("_s")))
    rows = rows.withColumn("_carry", F.coalesce(F.col("_s_base") + F.col("_carry"), "_s_carry")).withColumn("_base", F.col("_s_base") + F.col("_base")).withColumn("_no", F.col("_s_no") + F.col("_no"))
    # the file's last block with ids also ends what no end id closes
    final = (F.col("_n") > 0) & (F.col("_base") + F.col("_n") == F.col("_all")) & (F.col("_all") > F.col("_over"))
    rows = rows.withColumn("_ends", F.concat("_ends", F.when(final, F.array("_n")).otherwise(F.array().cast("array<long>"))))
    rows = rows.select("file", "_base", "_no", "_carry", "_k", "_ends", "cut_bytes", F.posexplode("_ends").alias("_i", "_end"))
    start = F.when(F.col("_i") == 0, F.col("_carry") + 1).otherwise(F.col("_base") + F.try_element_at("_ends", F.col("_i")) + 1)
    return rows.select("file", (F.col("_no") + F.col("_i")).alias("doc_no"), start.alias("start"), (F.col("_base") + F.col("_end") - start).alias("n_tokens"), (F.col("_i") < F.col("_k")).alias("ended"), "cut_bytes")


def op5_separator_scan(spark, sf_dir: str) -> DataFrame:
    """The token count of every document, from flat token files of the table in the shared folder, which are deleted once they are scanned."""
    path = f"{shared_dir(spark)}/tarmac-{uuid.uuid4().hex}"
    names = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    if names.isEmpty():
        return names.select("doc_id", F.lit(None).cast("long").alias("n_tokens"), "file", "doc_no", F.lit(None).cast("long").alias("start"), F.lit(None).cast("boolean").alias("ended"))
    found = separator_scan(read_token_files(spark, path, names=names)).withColumn("file", F.element_at(F.split("file", "/"), -1))
    deleted(spark, path)
    return names.join(found, ["file", "doc_no"], "left").select("doc_id", "n_tokens", "file", "doc_no", "start", "ended")
