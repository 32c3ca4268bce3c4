"""Token ids, packing, token rows, separators and shards against plain versions."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarmac.llm import packing, separators, sharding, token_rows, tokens

ODD = ["áb É̈", "don't DON'T İ. İ", "ΑΣ ΑΣ. Σ", "x\x1cy\x85z\xa0w  q", "<|endoftext|> hi", "Ⅷ ²³½ 12", "日本語 テスト。", "k\ńz", "", " \n\t", "a" * 5000, "WORD!! *** |", "it's."]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(tokens.tokenizer_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizer(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 50)
    rnd, mine = random.Random(5), tokens.Pieces(tokens.tokenizer_path())
    alphabet = "aAbBÉé'. ,!?3_#*\n\t\ŕ̈Σσßİı<|>\xa0"
    for text in ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]:
        assert np.frombuffer(mine.ids(text), "<u4").tolist() == tokenizer(text), text


@pytest.fixture
def docs(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["alpha", "beta.", "Gamma", "δέλτα"]) for _ in range(rnd.choice([0, 3, 40, 900]))) for _ in range(60)]
    rows = [(i, t, "extra") for i, t in enumerate(texts)] + [(7, None, None), (7, None, None), (None, "x y z", "q")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def _plain(docs, tokenizer):
    return [(r["doc_id"], [*tokenizer(r["text"]), 1]) for r in docs.collect()]


def test_pack_is_lossless(docs, tokenizer):
    rows = packing.pack(docs, capacity=256, group=40, max_piece=100).collect()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    want = Counter((d, len(ids)) for d, ids in _plain(docs, tokenizer))
    got = Counter()
    for r in rows:
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert got == Counter({k: k[1] * n for k, n in want.items()})
    ids = dict((d, ids) for d, ids in _plain(docs, tokenizer) if d not in (7, None))
    for r in rows:
        if r["doc_id"] in ids:
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]


def _differenced_plainly(sizes, k):
    parts = [[x] + [0] * (k - 1) for x in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0] - p[-1], reverse=True)
        a, b = parts[0], parts[1]
        parts = [sorted((x + y for x, y in zip(a, reversed(b))), reverse=True), *parts[2:]]
    return parts[0]


def test_differencing():
    rnd = random.Random(3)
    for _ in range(500):
        sizes = rnd.sample(range(1, 10**9), rnd.randint(1, 12))
        k = rnd.randint(2, 5)
        found = packing.differenced(sizes, k)
        assert sorted(i for w in found for i in w) == list(range(len(sizes))) and len(found) == k
        assert sorted((sum(sizes[i] for i in w) for w in found), reverse=True) == _differenced_plainly(sizes, k)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.differenced([8, 7, 6, 5, 4], 3)) == [8, 11, 11]
    assert packing.differenced([], 2) == [[], []] and packing.differenced([3, 4], 1) == [[0, 1]] or packing.differenced([3, 4], 1) == [[1, 0]]


def test_window_count_rises():
    assert len(packing.windows([60, 60, 60], 100)) == 3
    assert packing.windows([], 100) == []
    sizes = [random.Random(i).randint(1, 512) for i in range(1000)]
    found = packing.windows(sizes, 2048)
    assert max(sum(sizes[i] for i in w) for w in found) <= 2048 and sum(sizes) / len(found) / 2048 > 0.95


def test_best_fit_is_the_tightest_row():
    rnd = random.Random(1)
    for _ in range(200):
        cap = rnd.choice([7, 8, 16, 100, 2048])
        sizes = [rnd.randint(1, cap) for _ in range(rnd.randint(0, 80))]
        rows, free = token_rows.best_fit(sizes, cap), []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [(f, j) for j, f in enumerate(free) if f >= sizes[i]]
            if fits:
                free[min(fits)[1]] -= sizes[i]
            else:
                free.append(cap - sizes[i])
        assert sorted(free) == sorted(cap - sum(sizes[i] for i in r) for r in rows)


def test_op3_reads_back_what_it_wrote(spark, tokenizer, tmp_path, monkeypatch):
    rows = [(i, t) for i, t in enumerate([*ODD, "long words " * 3000, None, None, "tie", "tie"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(token_rows, "shared_dir", lambda _: str(tmp_path / "shared"))
    out = {r["row_id"]: r for r in token_rows.op3_best_fit_token_rows(spark, str(tmp_path)).collect()}
    (path,) = (tmp_path / "shared").iterdir()
    got = defaultdict(dict)
    for r in spark.read.parquet(str(path)).collect():
        ids, positions = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["positions"], "<u2")
        cu = r["cu_seqlens"]
        assert len(ids) == len(positions) == token_rows.CAPACITY and cu[-1] == r["n_ids"] and not ids[cu[-1] :].any()
        assert positions[: cu[-1]].tolist() == [k for a, b in zip(cu, cu[1:]) for k in range(b - a)]
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], cu[:-1], cu[1:], strict=True):
            got[doc][start] = ids[a:b].tolist()
        o = out.pop(r["row_id"])
        assert (o["ids_crc32"], o["positions_crc32"]) == (zlib.crc32(r["ids"]), zlib.crc32(r["positions"]))
        assert (o["n_ids"], o["cu_seqlens"], o["doc_ids"], o["starts"]) == (r["n_ids"], cu, r["doc_ids"], r["starts"])
    assert not out
    for i, text in rows:
        pieces = sorted(got[i].items())
        assert [x for x, _ in pieces] == [token_rows.CAPACITY * k for k in range(len(pieces))]
        assert sum((ids for _, ids in pieces), []) == tokenizer(text) + [1]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert token_rows.op3_best_fit_token_rows(spark, f"{tmp_path}/none").count() == 0


def test_token_rows_are_lossless(docs, tokenizer, tmp_path):
    made = token_rows.token_rows(docs, capacity=128, group=30)
    token_rows.write_rows(made, str(tmp_path / "rows"))
    parts = defaultdict(dict)
    total = 0
    for r in docs.sparkSession.read.parquet(str(tmp_path / "rows")).collect():
        ids, pos, cu = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["positions"], "<u2"), r["cu_seqlens"]
        assert len(ids) == len(pos) == 128 and cu[0] == 0 and cu[-1] == r["n_ids"] and (ids[r["n_ids"] :] == 0).all()
        for a, b, doc, start in zip(cu, cu[1:], r["doc_ids"], r["starts"]):
            assert pos[a:b].tolist() == list(range(b - a))
            total += b - a
            parts[doc].setdefault(start, []).append(ids[a:b].tolist())
    plain = _plain(docs, tokenizer)
    assert total == sum(len(ids) for _, ids in plain)
    for doc, ids in plain:
        if doc not in (7, None):
            assert [x for s in sorted(parts[doc]) for x in parts[doc][s][0]] == ids
    assert token_rows.token_rows(docs.where("false")).count() == 0 and packing.pack(docs.where("false")).count() == 0


@pytest.mark.parametrize("block_bytes, span_blocks", [(2, 5), (6, 1), (64, 3), (1 << 18, 256)])
def test_separator_scan_of_written_files(docs, tokenizer, tmp_path, block_bytes, span_blocks):
    few = docs.where("length(coalesce(text, '')) < 400")
    names = separators.write_token_files(few, str(tmp_path / "flat"))
    (tmp_path / "flat" / "left.bin").write_bytes(b"\1\2\3")  # what a lost task may leave
    blocks = separators.read_token_files(few.sparkSession, str(tmp_path / "flat"), block_bytes=block_bytes, span_blocks=span_blocks, names=names)
    found = separators.separator_scan(blocks, span_blocks=span_blocks).withColumn("file", F.element_at(F.split("file", "/"), -1))
    rows = names.join(found, ["file", "doc_no"], "full").collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == Counter((d, len(ids) - 1) for d, ids in _plain(few, tokenizer))
    assert all(r["ended"] and not r["cut_bytes"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["file"]].append((r["doc_no"], r["start"], r["n_tokens"]))
    for own in by.values():
        at = 0
        for i, (no, start, n) in enumerate(sorted(own)):
            assert (no, start) == (i, at)
            at += n + 1


def test_separator_query(spark, tokenizer, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = separators.op5_separator_scan(spark, str(tmp_path))
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == Counter((d, len(ids) - 1) for d, ids in _plain(docs, tokenizer))
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    empty = separators.op5_separator_scan(spark, str(tmp_path))
    assert empty.count() == 0 and empty.dtypes == got.dtypes


def test_separator_scan_counts_cut_bytes(spark, tmp_path, monkeypatch):
    (tmp_path / "a.bin").write_bytes(np.array([5, 9, 7], "<u2").tobytes() + b"\1")
    (tmp_path / "b.bin").write_bytes(np.array([9, 9], "<u2").tobytes())
    for ranged in (separators.RANGED, set()):
        monkeypatch.setattr(separators, "RANGED", ranged)
        blocks = separators.read_token_files(spark, str(tmp_path), block_bytes=4)
        got = sorted((r["file"][-5], *r[1:]) for r in separators.separator_scan(blocks, end_id=9).collect())
        assert got == [("a", 0, 0, 1, True, 1), ("a", 1, 2, 1, False, 1), ("b", 0, 0, 0, True, 0), ("b", 1, 1, 0, True, 0)]


@pytest.mark.parametrize("block_bytes", [4, 12, 4096])
def test_separator_scan_of_files(spark, tmp_path, block_bytes):
    runs = {"a": [5, 9, 5, 9, 9, 3, 9], "b": [], "c": [9], "d": [1, 2, 3], "e": [1] * 300 + [9, 2]}
    for name, ids in runs.items():
        (tmp_path / f"{name}.bin").write_bytes(np.array(ids, "<u4").tobytes() + (b"\1" if name == "d" else b""))
    blocks = separators.read_token_files(spark, str(tmp_path), width=4, block_bytes=block_bytes)
    got = sorted((r["file"][-5], r["doc_no"], r["start"], r["n_tokens"], r["ended"]) for r in separators.separator_scan(blocks, end_id=9, width=4).collect())
    want = []
    for name, ids in runs.items():
        start, no = 0, 0
        for i, x in enumerate(ids):
            if x == 9:
                want.append((name, no, start, i - start, True))
                start, no = i + 1, no + 1
        if start < len(ids):
            want.append((name, no, start, len(ids) - start, False))
    assert got == sorted(want)


def test_flat_files_by_the_text_writer(spark, tmp_path):
    """A file of ids and end ids, as any writer may leave it, read as blocks."""
    ids = spark.createDataFrame([(bytearray(np.array([300, 2], "<u2").tobytes()),), (bytearray(),)], "b binary")
    ids.select(F.col("b").cast("string").alias("value")).coalesce(1).write.option("lineSep", "\x09\x00").text(str(tmp_path / "flat"))
    blocks = separators.read_token_files(spark, str(tmp_path / "flat" / "part-*"), width=2, block_bytes=4)
    assert sorted(r["n_tokens"] for r in separators.separator_scan(blocks, end_id=9, width=2).collect()) == [0, 2]


@pytest.fixture
def sources(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("aaaaabbc"), "t" * (i % 7)) for i in range(1000)] + [(5, None, "x"), (5, None, "x"), (None, "d", None)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


@pytest.mark.parametrize("shards", [1, 7, 16])
def test_shards_match_the_mixture(sources, shards):
    rows = sharding.interleave(sources, shards).collect()
    n = len(rows)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert n == 1003 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    for s, k in Counter(r["source"] for r in rows).items():
        for own in by.values():
            assert abs(sum(r["source"] == s for r in own) - k * len(own) / n) <= 1.5


def test_shards_repeat_whatever_the_partitions(sources):
    key = lambda df: sorted(map(repr, sharding.interleave(df, 5).collect()))
    assert key(sources) == key(sources.repartition(7))
    assert key(sources) != sorted(map(repr, sharding.interleave(sources, 5, seed=3).collect()))


def test_shards_equal_a_plain_ranking(sources):
    """Ranks within the sources and their fractions, by plain sorting."""
    hashed = sources.withColumn("h", F.xxhash64(F.lit(17), *sources.columns))
    groups = defaultdict(list)
    for r in hashed.collect():
        groups[r["source"]].append(r)
    order = []
    for own in groups.values():
        for i, r in enumerate(sorted(own, key=lambda r: (_bucket(r["h"]), r["h"] % (1 << 62), repr(r)))):
            order.append(((2 * i + 1) / (2 * len(own)), r["h"], repr(r[:3]), r))
    order.sort(key=lambda x: x[:3])
    n = len(order)
    want = Counter((r["doc_id"], r["source"], i * 5 // n) for i, (*_, r) in enumerate(order))
    assert want == Counter((r["doc_id"], r["source"], r["shard"]) for r in sharding.interleave(sources, 5).collect())


def _bucket(h):
    return ((h & 0xFFFFFFFFFFFFFFFF) >> 33) * sharding.BUCKETS // (1 << 31)


def test_shards_edges(spark, sources):
    assert sharding.interleave(sources.where("false"), 4).count() == 0
    clash = sharding.interleave(sources.withColumn("shard", F.lit("mine")).withColumn("_h", F.lit(1)), 3)
    assert clash.columns[-2:] == ["shard_", "slot"] and clash.where("shard = 'mine' and _h = 1").count() == 1003
    few = sharding.interleave(spark.createDataFrame([(1, "a")], "doc_id long, source string"), 16).collect()
    assert [(r["shard"], r["slot"]) for r in few] == [(0, 0)]


def test_crc_of_op7(spark, tmp_path):
    spark.createDataFrame([(3, "alpha beta")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    (r,) = packing.op7_differencing_packing(spark, str(tmp_path)).collect()
    ids = np.frombuffer(tokens.pieces(tokens.tokenizer_path()).ids("alpha beta"), "<u4").tolist() + [1]
    assert (r["ids_crc32"], r["doc_tokens"], r["length"]) == (zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids), len(ids))


@pytest.mark.parametrize("parts", [1, 8, 250])
def test_small_partitions_are_filled(spark, parts):
    rnd = random.Random(parts)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rnd.randint(20, 900)))) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = packing.pack(df).agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("k")).first()
    assert got["n"] / (2048 * got["k"]) > 0.95
    got = token_rows.token_rows(df).agg(F.sum("n_ids").alias("n"), F.count("*").alias("k")).first()
    assert got["n"] / (2048 * got["k"]) > 0.95


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("a-1", "some words here"), (None, "more"), ("a-1", None)], "doc_id string, text string")
    packed = packing.pack(df)
    assert packed.schema["doc_id"].dataType.simpleString() == "string" and {r["doc_id"] for r in packed.collect()} == {"a-1", None}
    rows = token_rows.token_rows(df)
    assert rows.schema["doc_ids"].dataType.simpleString() == "array<string>"
    assert sorted((d for r in rows.collect() for d in r["doc_ids"]), key=str) == [None, "a-1", "a-1"]
    assert packing.pack(df.where("false")).count() == token_rows.token_rows(df.where("false")).count() == 0
