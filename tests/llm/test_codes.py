"""Heap Lloyd against plain Lloyd rounds, in whole numbers."""

import hashlib
import math

import numpy as np
import pytest

pytest.importorskip("tarmac.llm.heap_lloyd")

from tarmac.llm import heap_lloyd as hl

SCHEMA = "vec_id long, embedding array<float>, label int, _x string, code int"


def plain(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error) of each kept row in their order, the codebooks' digest, and the assignments of each round."""
    rows = [(i, x, n) for i, x, n in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    if not rows:
        return [], []
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, [np.float32(v) for v in r[1]]))
    rows = [r for r in rows if len(r[1]) == len(rows[0][1])]
    x = np.array([[math.floor(256 * float(np.float32(v))) for v in r[1]] for r in rows], dtype=np.int64).reshape(len(rows), len(rows[0][1]))
    width = x.shape[1]
    codes, error, text, history = np.zeros((len(x), parts), int), np.zeros(len(x), np.int64), [], []
    books = [x[:entries, p * width // parts : (p + 1) * width // parts].copy() for p in range(parts)]
    for k in range(rounds + 1):
        error[:] = 0
        for p in range(parts):
            own = x[:, p * width // parts : (p + 1) * width // parts]
            d = ((own[:, None] - books[p][None]) ** 2).sum(2)
            codes[:, p] = d.argmin(1)
            error += d.min(1)
            if k < rounds:
                for e in range(len(books[p])):
                    if (codes[:, p] == e).any():
                        books[p][e] = [int(v) // int((codes[:, p] == e).sum()) for v in own[codes[:, p] == e].sum(0)]
        history.append(codes.copy())
    for b in books:
        text += [str(int(v)) for v in b.ravel()]
    digest = hashlib.sha256(",".join(text).encode()).hexdigest()
    by_label = {}
    for r, e in zip(rows, error.tolist(), strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return [(r[0], bytes(c.tolist()).hex(), e, by_label[r[2]], digest) for r, c, e in zip(rows, codes, error.tolist(), strict=True)], history


def made(n, width=32, seed=1, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, width)) * spread
    return [(i, (centres[i % 40] + rng.normal(size=width) * 0.2).astype(np.float32).tolist(), int(i % 5) if i % 7 else None) for i in range(n)]


def saved(spark, path, rows):
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def check(spark, path, rows):
    got = [tuple(r) for r in hl.op13_heap_lloyd_codes(spark, saved(spark, path, rows)).collect()]
    want, _ = plain(rows)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_equals_plain_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hl, "BLOCK_ROWS", 100)
    check(spark, tmp_path, made(1200))


def test_nulls_ties_repeats_and_odd_vectors(spark, tmp_path):
    rows = made(90, 16) * 2
    rows += [(None, rows[3][1], 1), (200, None, 1), (201, [*rows[0][1][:-1], None], 1), (202, [float("nan")] * 16, 1), (203, [float("inf")] * 16, 1), (204, [1.0] * 8, 1), (205, [], 1), (3, [0.5] * 16, None), (300, [-0.001] * 16, 2), (301, [0.0] * 16, 2)]
    check(spark, tmp_path, rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(5, [0.1] * 16, None)], [(1, [], 1), (2, [], None)], [(i, [1.0] * 16, 1) for i in range(200)], [(i, [float(i % 3)] * 19, i % 2) for i in range(30)]])
def test_small_tables(spark, tmp_path, rows):
    check(spark, tmp_path, rows)


def test_later_rounds_pop_few_parts_and_miss_none(spark, monkeypatch):
    monkeypatch.setattr(hl, "BLOCK_ROWS", 256)
    rows = made(2000, 32, seed=3, spread=4.0)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(2)
    out, books, states = hl.compress(df, rounds=4)
    want, history = plain(rows, rounds=4)
    assert {(r["_id"], r["code"], r["error"]) for r in out.collect()} == {w[:3] for w in want} and books.digest() == want[0][4]
    scans = [s.agg({"_scans": "sum"}).first()[0] for s in states]
    assert scans[0] == 2000 * 16 and all(n < 0.5 * scans[0] for n in scans[2:])
    for s, codes in zip(states, history, strict=False):
        got = {i: bytes(c) for r in s.where("_x IS NOT NULL").collect() for i, c in zip(r["_id"], np.frombuffer(r["_codes"], np.uint8).reshape(-1, 16), strict=True)}
        assert got == {i: bytes(c.tolist()) for i, c in enumerate(codes)}


def test_heaps_hold_every_part_under_its_entry(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-300, 300, (500, 32)).astype(np.int32)
    books = hl.Codebooks(x[:20], 4)
    codes, gaps = (np.stack(v, 1) for v in zip(*[books.nearest(x, p) for p in range(4)], strict=True))
    heaps = hl.Heaps.of(codes, gaps, books)
    for _ in range(3):
        total = np.zeros((20, 36), np.int64)
        hl._summed(total, x, codes, books)
        books = books.moved(total[:, :32], total[:, 32:])
        assert heaps.popped(x, codes, books) < 2000
        at = 0
        for s, n in enumerate(heaps.sizes):
            own = heaps.items[at : at + n]
            assert all(own[(i - 1) // 2] <= own[i] for i in range(1, n))
            assert sorted(int(v) & 0xFFFF for v in own) == np.flatnonzero(codes[:, s // 20] == s % 20).tolist()
            at += n
        for p in range(4):
            assert (books.nearest(x, p)[0] == codes[:, p]).all()
