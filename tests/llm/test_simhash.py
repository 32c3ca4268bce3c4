"""SimHash components against brute force: over texts, and over made fingerprints with dense groups."""

import numpy as np
import pytest

pytest.importorskip("tarmac.llm.simhash")
import xxhash

from tarmac.llm import simhash as sh


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints):
    """The least id reachable, for (id, fingerprint) pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (n, _) in enumerate(prints):
        if n is not None:
            least[find(i)] = min(n, least.get(find(i), n))
    return [least.get(find(i)) for i in range(len(prints))]


BASE = "the quick brown fox jumps over the lazy dog and runs away from all of them at once"
TEXTS = [
    (4, BASE), (9, BASE), (2, BASE.upper()), (4, BASE), (None, BASE), (11, None), (12, ""), (13, " \t\n"), (None, ""), (20, "one"), (21, "One  "), (22, "one two"), (23, "one two three"),
    (30, "a\x0bb\x0cc\rd"), (31, "a b c d"), (32, "a\x1fb c d"), (33, "É é É"), (34, "é É é"), (40, " ".join(f"w{i % 977}" for i in range(90_000))),
]


def test_fingerprints_and_groups_of_texts(spark, tmp_path):
    docs = spark.createDataFrame([(*t, 1, "x") for t in TEXTS], "doc_id long, text string, _f int, _id string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = list(zip([i for i, _ in TEXTS], [f"{plain(t):016x}" for _, t in TEXTS], grouped([(i, plain(t)) for i, t in TEXTS]), strict=True))
    got = [tuple(r) for r in sh.op12_simhash_components(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert dict((r[0], r[2]) for r in got)[13] == 11


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sh.op12_simhash_components(spark, str(tmp_path)).count() == 0


def near(seed, groups, each, far):
    """Fingerprints in groups of ``each`` that differ by up to ``far`` bits from their centre."""
    rng = np.random.default_rng(seed)
    out = []
    for c in rng.integers(0, 1 << 64, groups, np.uint64):
        for _ in range(each):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, far + 1)):
                x ^= 1 << int(b)
            out.append(x)
    return out


@pytest.mark.parametrize(("groups", "each", "far", "division"), [(150, 2, 5, 1024), (3, 100, 6, 8), (1, 250, 3, 16), (1, 250, 12, 16)])
def test_groups_of_made_fingerprints(spark, monkeypatch, groups, each, far, division):
    monkeypatch.setattr(sh, "DIVISION", division)
    made = [(i, x) for i, x in enumerate(near(groups, groups, each, far))]
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in made]
    got = {r["_f"]: r["_least"] for r in sh.near_groups(spark.createDataFrame(signed, "_id long, _f long")).collect()}
    assert [got[f] for _, f in signed] == grouped(made)


@pytest.mark.parametrize("m", [4, 5, 6, 7])
def test_linked_pairs_share_a_cell(spark, m):
    rng = np.random.default_rng(m)
    widths = [len(x) for x in np.array_split(np.arange(64), m)]
    pairs = []
    for _ in range(100):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, 3, replace=False):
            b ^= 1 << int(bit)
        pairs.append((a, b - (1 << 64) if b >> 63 else b))
    rows = spark.createDataFrame([(f,) for p in pairs for f in p], "_f long")
    cells = {}
    for r in sh.celled(sh.with_distances(rows), widths).collect():
        cells.setdefault(r["_f"], set()).add(r["_c"])
    assert all(cells[a] & cells[b] for a, b in pairs)


def test_distances_discard_before_bits_are_compared():
    rng = np.random.default_rng(0)
    f = np.sort(rng.integers(0, 1 << 64, 2000, np.uint64))
    d = np.bitwise_count(f[:, None] ^ sh.references()[None]).astype(np.int16)
    order = np.argsort(d[:, 0], kind="stable")
    x, _, verified = sh.linked(np.zeros(2000, np.int64), f[order].view(np.int64), d[order])
    assert not len(x) and verified < 100  # of 1,999,000 pairs
    assert sh.blocks_of(1000) == [16] * 4 and len(sh.blocks_of(1 << 24)) == 5 and len(sh.blocks_of(1 << 36)) == 6
