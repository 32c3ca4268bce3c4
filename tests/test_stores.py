"""The key-value source: commits, aborts, generations and keys."""

import os

import pytest

from tarmac.plans import serving
from tarmac.sources import keyvalue as kv
from tarmac.sources.files import qualified, store_of


@pytest.fixture
def rows(spark):
    return lambda entries: spark.createDataFrame([(k, f, v, s) for k, f, v, s in entries], kv.SCHEMA).repartition(3)


def stored(spark, path, run=None, keys=None):
    return sorted(map(tuple, kv.get(spark, path, run, keys).collect()), key=repr)


HASHES = [(f"h:{i}", f, str(i), None) for i in range(40) for f in "ab"]
RANKING = [("r", "x", None, 2.0), ("r", "y", None, None)]


def test_round_trip_of_hashes_and_rankings(spark, tmp_path, rows):
    kv.put(rows(HASHES + RANKING), str(tmp_path), "one", buckets=5)
    kv.put(rows([("other", "f", "", None)]), str(tmp_path), "two")
    assert stored(spark, str(tmp_path), "one") == sorted(HASHES + RANKING, key=repr)
    assert stored(spark, str(tmp_path)) == sorted([*HASHES, *RANKING, ("other", "f", "", None)], key=repr)
    assert stored(spark, str(tmp_path), "one", ["h:7", "r", "none"]) == sorted([*[r for r in HASHES if r[0] == "h:7"], *RANKING], key=repr)
    assert serving.rankings_of(kv.get(spark, str(tmp_path), "one")).count() == 2 and serving.hashes_of(kv.get(spark, str(tmp_path), "one")).count() == 80
    assert stored(spark, str(tmp_path), "never") == []


def test_a_shorter_run_leaves_no_key_and_old_files_go(spark, tmp_path, rows):
    for n in (40, 3, 2, 1):
        kv.put(rows(HASHES[: 2 * n]), str(tmp_path), "one")
        assert stored(spark, str(tmp_path), "one") == sorted(HASHES[: 2 * n], key=repr)
    left = os.listdir(tmp_path / "one")
    assert sum(x.startswith("manifest") for x in left) == kv.KEPT and sum(x.startswith("generation") for x in left) == kv.KEPT


def test_appended_keys_replace_theirs_alone(spark, tmp_path, rows):
    kv.put(rows(HASHES), str(tmp_path), "one", buckets=4)
    kv.put(rows([("h:0", "c", "new", None), ("more", "a", "1", None)]), str(tmp_path), "one", mode="append", buckets=9)
    want = [r for r in HASHES if r[0] != "h:0"] + [("h:0", "c", "new", None), ("more", "a", "1", None)]
    assert stored(spark, str(tmp_path), "one") == sorted(want, key=repr)
    assert stored(spark, str(tmp_path), "one", ["h:0"]) == [("h:0", "c", "new", None)]


def test_a_failed_task_leaves_nothing(spark, tmp_path, rows):
    kv.put(rows(HASHES[:6]), str(tmp_path), "one")
    before = sorted(os.listdir(tmp_path / "one"))
    with pytest.raises(Exception, match="a key is null"):
        kv.put(rows([*HASHES, (None, "f", "v", None)]), str(tmp_path), "one")
    assert sorted(os.listdir(tmp_path / "one")) == before and stored(spark, str(tmp_path), "one") == sorted(HASHES[:6], key=repr)


def test_no_rows_and_repeated_fields(spark, tmp_path, rows):
    kv.put(rows([("k", "f", "1", None), ("k", "f", "3", None), ("k", "f", "2", None)]), str(tmp_path), "one")
    assert stored(spark, str(tmp_path), "one") == [("k", "f", "3", None)]
    kv.put(spark.createDataFrame([], kv.SCHEMA), str(tmp_path), "one")
    assert stored(spark, str(tmp_path), "one") == []


def test_filters_on_keys_reach_the_source(spark, tmp_path, rows):
    kv.put(rows(HASHES + RANKING), str(tmp_path), "one")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = kv.get(spark, str(tmp_path), "one").where("key = 'h:3' AND field = 'a'")
        assert [tuple(r) for r in df.collect()] == [("h:3", "a", "3", None)]
        assert df.rdd.getNumPartitions() == 1
        assert {r["key"] for r in kv.get(spark, str(tmp_path), "one").where("key IN ('h:1', 'r')").collect()} == {"h:1", "r"}
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_addresses(spark, tmp_path):
    assert qualified(spark, str(tmp_path)) == f"file:{tmp_path}" or qualified(spark, str(tmp_path)).startswith("file:///")
    with pytest.raises(ValueError, match="names no store"):
        store_of("/some/folder")
    with pytest.raises(ValueError, match="cannot open"):
        store_of("viewfs://x/y")
    with pytest.raises(Exception, match="takes the columns"):
        spark.dataSource.register(kv.KeyValueSource)
        spark.range(2).write.format("keyvalue").mode("overwrite").option("path", f"file:{tmp_path}").option("run", "x").save()


def test_rankings_are_published(spark, tmp_path):
    log = str(tmp_path / "log")

    class Client:
        def say(self, *what):
            with open(log, "a") as f:
                f.write(f"{what}\n")

        hset = zadd = say

    serving.publish(serving.entries(None, spark.createDataFrame([("r", "m", 1.5), ("r", "n", None)], "key string, member string, score double")), Client)
    assert open(log).read() == "('r', {'m': 1.5})\n"
