"""A key-value store as a Spark data source, ``keyvalue``: hashes and rankings that are replaced a run at a time.

A row with a value is a field of the hash ``key``; one without is a member of the ranking ``key``, and may have a
score. A store is a folder in which a run is a series of generations. Tasks write files of their own, by bucket of
the key, into a new generation's folder; the commit lists the files of the tasks that succeeded in a manifest and
puts the manifest in place with one rename, so that readers see the old keys or the new ones and never a mixture.
Overwriting replaces all keys of the run; appending replaces those that the new rows have. An aborted write
deletes its folder.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from tarmac.sources.files import qualified, store_of

SCHEMA = "key string, field string, value string, score double"
NAMES = ["key", "field", "value", "score"]
#: Files by key that a task writes, and that readers are spread over; the manifests that stay.
BUCKETS, KEPT = 16, 2


def bucket_of(key: str, buckets: int) -> int:
    return zlib.crc32(key.encode()) % buckets


@dataclass
class Parts(WriterCommitMessage):
    """(bucket, file) of a task."""

    files: list


@dataclass
class Bucket(InputPartition):
    """A run's files of one bucket, from the newest generation to the oldest."""

    generations: list


class _Runs:
    """The manifests of a store."""

    def __init__(self, path: str):
        self.system, self.top = store_of(path)

    def names(self) -> list[str]:
        from pyarrow import fs

        found = self.system.get_file_info(fs.FileSelector(self.top, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.Directory)

    def manifests(self, run: str) -> list[str]:
        """Paths of a run's manifests, the newest first."""
        from pyarrow import fs

        found = self.system.get_file_info(fs.FileSelector(f"{self.top}/{run}", allow_not_found=True))
        return sorted((f.path for f in found if f.base_name.startswith("manifest-")), reverse=True)

    def read(self, manifest: str) -> dict:
        with self.system.open_input_stream(manifest) as f:
            return json.loads(f.read())

    def current(self, run: str) -> dict:
        """buckets, and generations (newest first) of a folder and its (bucket, file) pairs; none before the first commit."""
        found = self.manifests(run)
        return self.read(found[0]) if found else {"number": 0, "buckets": BUCKETS, "generations": []}


class KeyValueWriter(DataSourceArrowWriter):
    def __init__(self, path: str, run: str, buckets: int, overwrite: bool):
        self.path, self.run, self.overwrite = path, run, overwrite
        now = _Runs(path).current(run)
        # what is added to has the buckets that it was made with
        self.buckets = buckets if overwrite or not now["generations"] else now["buckets"]
        self.folder = f"generation-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Parts:
        import numpy as np
        import pyarrow.parquet as pq

        system, top = store_of(self.path)
        folder, task, open_ = f"{top}/{self.run}/{self.folder}", uuid.uuid4().hex, {}
        try:
            for batch in iterator:
                if batch.column(0).null_count:
                    raise ValueError("a key is null")
                keys = batch.column(0).dictionary_encode()
                by_key = np.array([bucket_of(k, self.buckets) for k in keys.dictionary.to_pylist()], np.int64)
                own = by_key[keys.indices.to_numpy()] if len(keys) else by_key
                for b in np.unique(own).tolist():
                    if b not in open_:
                        system.create_dir(folder, recursive=True)
                        open_[b] = pq.ParquetWriter(f"{folder}/{task}-{b}.parquet", batch.schema, filesystem=system)
                    open_[b].write_batch(batch.filter(own == b))
        finally:
            for w in open_.values():
                w.close()
        return Parts([(b, f"{task}-{b}.parquet") for b in open_])

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        runs = _Runs(self.path)
        top = f"{runs.top}/{self.run}"
        before = runs.current(self.run)
        files = [f for m in messages if m is not None for f in m.files]
        named = {f for _, f in files}
        for f in runs.system.get_file_info(fs.FileSelector(f"{top}/{self.folder}", allow_not_found=True)):
            if f.base_name not in named:  # of attempts that were lost or repeated
                runs.system.delete_file(f.path)
        new = {"number": before["number"] + 1, "buckets": self.buckets, "generations": [[self.folder, files], *([] if self.overwrite else before["generations"])]}
        runs.system.create_dir(top, recursive=True)
        draft, target = f"{top}/draft-{uuid.uuid4().hex}", f"{top}/manifest-{new['number']:012d}.json"
        if runs.system.get_file_info(target).type != fs.FileType.NotFound:
            raise RuntimeError(f"another write of {self.run} was committed meanwhile")
        with runs.system.open_output_stream(draft) as out:
            out.write(json.dumps(new).encode())
        runs.system.move(draft, target)
        self._clear(runs, top)

    def _clear(self, runs: _Runs, top: str) -> None:
        """Delete manifests but the last ones (readers may still have planned on the one before), and folders that none of those names."""
        from pyarrow import fs

        found = runs.manifests(self.run)
        for old in found[KEPT:]:
            named = {g for m in found[:KEPT] for g, _ in runs.read(m)["generations"]}
            for g, _ in runs.read(old)["generations"]:
                if g not in named and runs.system.get_file_info(f"{top}/{g}").type != fs.FileType.NotFound:
                    runs.system.delete_dir(f"{top}/{g}")
            runs.system.delete_file(old)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system, top = store_of(self.path)
        if system.get_file_info(f"{top}/{self.run}/{self.folder}").type != fs.FileType.NotFound:
            system.delete_dir(f"{top}/{self.run}/{self.folder}")


class KeyValueReader(DataSourceReader):
    """Reads one run, or all; of some keys only their buckets' files and rows."""

    def __init__(self, path: str, run: str | None, keys: list[str] | None):
        self.path, self.run, self.keys = path, run, keys

    def partitions(self) -> list[Bucket]:
        runs, out = _Runs(self.path), []
        for run in [self.run] if self.run else runs.names():
            now = runs.current(run)
            wanted = range(now["buckets"]) if self.keys is None else sorted({bucket_of(k, now["buckets"]) for k in self.keys if k is not None})
            for b in wanted:
                files = [[f"{runs.top}/{run}/{g}/{f}" for c, f in parts if c == b] for g, parts in now["generations"]]
                if any(files):
                    out.append(Bucket(files))
        return out or [Bucket([])]

    def read(self, partition: Bucket) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        system, _ = store_of(self.path)
        seen = pa.array([], pa.string())
        for files in partition.generations:
            if not files:
                continue
            some = None if self.keys is None else pc.field("key").isin([k for k in self.keys if k is not None])
            rows = pa.concat_tables([pq.read_table(f, filesystem=system, columns=NAMES, filters=some) for f in files])
            rows = rows.filter(pc.invert(pc.is_in(rows["key"], value_set=seen)))  # a newer generation has the key
            seen = pa.concat_arrays([seen, rows["key"].unique()])
            one = rows.group_by(["key", "field"]).aggregate([("value", "max"), ("score", "max")])
            yield from one.rename_columns(NAMES).to_batches()


class PushedReader(KeyValueReader):
    """A reader that takes keys from a query's filters; Spark allows it where spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            wanted = [f.value] if isinstance(f, EqualTo) and f.attribute == ("key",) else list(f.value) if isinstance(f, In) and f.attribute == ("key",) else None
            if wanted is None:
                yield f
            else:
                self.keys = wanted if self.keys is None else [k for k in self.keys if k in wanted]


class KeyValueSource(DataSource):
    """Options: path (a full address), run, buckets (of a new run), keys (JSON) to read only those, and pushed to take them from filters."""

    @classmethod
    def name(cls) -> str:
        return "keyvalue"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> KeyValueReader:
        keys = self.options.get("keys")
        kind = PushedReader if self.options.get("pushed") == "true" else KeyValueReader
        return kind(self.options["path"], self.options.get("run"), json.loads(keys) if keys is not None else None)

    def writer(self, schema, overwrite: bool) -> KeyValueWriter:
        if schema.names != NAMES:
            raise ValueError(f"a key-value store takes the columns {', '.join(NAMES)}, not {', '.join(schema.names)}")
        return KeyValueWriter(self.options["path"], self.options["run"], int(self.options.get("buckets", BUCKETS)), overwrite)


def put(entries: DataFrame, path: str, run: str, mode: str = "overwrite", buckets: int = BUCKETS) -> None:
    """Write rows of ``SCHEMA`` as the keys of a run: all of its keys ("overwrite"), or only those they have ("append").

    A null key is an error, after which the run is as it was. Of several values of a field the greatest stands.
    """
    spark = entries.sparkSession
    spark.dataSource.register(KeyValueSource)
    rows = entries.select(*NAMES)
    rows.write.format("keyvalue").mode(mode).option("path", qualified(spark, path)).option("run", run).option("buckets", buckets).save()


def get(spark: SparkSession, path: str, run: str | None = None, keys: Sequence[str] | None = None) -> DataFrame:
    """The rows of a run, or of all runs; of the named keys only, by their buckets' files. A run that was never written has none.

    Where the session lets Python sources take filters, filters on the key name keys as well.
    """
    spark.dataSource.register(KeyValueSource)
    found = spark.read.format("keyvalue").option("path", qualified(spark, path)).option("pushed", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if run is not None:
        found = found.option("run", run)
    return (found if keys is None else found.option("keys", json.dumps(list(keys)))).load()
