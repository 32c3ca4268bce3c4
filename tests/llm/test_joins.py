"""Jaccard join, components, top-k search and raking against brute force."""

import os
import random
from functools import reduce
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.llm import jaccard, raking, shingles, topk
from tarmac.llm.components import components


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x09\x0a\x0b\x0c\x0d":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def plain_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def _changed(rnd, base, k):
    w = base[:]
    for _ in range(k):
        w[rnd.randrange(len(w))] = f"n{rnd.random()}"
    return w


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    rows = []
    for g in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([5, 6, 9, 30, 100, 200]))]
        for _ in range(rnd.choice([1, 2, 5, 30])):
            rows.append(_changed(rnd, base, rnd.choice([0, 0, 1, 2, 3])))
    # a chain, each near the next, and documents that share a passage alone
    link = [rnd.choice(vocabulary) for _ in range(120)]
    for _ in range(10):
        link = link[4:] + [rnd.choice(vocabulary) for _ in range(4)]
        rows.append(link)
    for _ in range(90):
        rows.append(passage + [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 8, 12, 20]))])
    rnd.shuffle(rows)
    texts = [" ".join(w) for w in rows] + [None, "", " \n ", "One two", "one  TWO", "one two three", "É a b c d", "é a b c d", "x\x0by z q\x85 r"]
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "common", "divided", "leaf", "growth"), [(1, 3, 2, 1 << 20, 2.0), (2, 64, 1, -1, 1e9), (1, 3, 1, -1, 1.0)])
def test_components_equal_brute_force(spark, monkeypatch, seed, common, divided, leaf, growth):
    """With small regions joined in a task, with every region divided into cells, and with none divided that grows."""
    for name, value in (("COMMON_SETS", common), ("DIVIDED", divided), ("LEAF_PAIRS", leaf), ("GROWTH", growth), ("PIVOTS", (1, 3, 8, 64))):
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(seed)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_components(rows)


def test_cells_hold_every_linked_pair(spark, monkeypatch):
    """One level of division: sets within the radius of each other meet in a cell, and cells are smaller than their region."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(jaccard, "GROWTH", 100.0)
    points, pivots = rng.random((300, 2)), rng.random((6, 2))
    apart = lambda a, b: float(np.abs(a - b).max() / 1.2)
    rows = spark.createDataFrame([(1, v, 10, 0, 0.0, 1.0, 306) for v in range(300)], "s long, v long, n int, g long, lo double, hi double, m long")
    met = []
    for v in range(300):
        for p in range(6):
            d = apart(points[v], pivots[p])
            met.append((1, v, p, d - 0.05, d if d - 0.05 <= jaccard.CUT else None))
    monkeypatch.setattr(jaccard, "CUT", 0.25)
    cells = jaccard._cells(rows, spark.createDataFrame(met, "s long, v long, p long, near double, d double")).collect()
    at = defaultdict(dict)
    for r in cells:
        at[r["s"]][r["v"]] = (r["lo"], r["hi"])
    assert len(at) > 4 and max(map(len, at.values())) < 300
    for v in range(300):
        for u in range(v):
            if apart(points[u], points[v]) <= 0.2:
                assert any(u in c and v in c and c[u][0] - c[v][1] <= jaccard.RADIUS and c[v][0] - c[u][1] <= jaccard.RADIUS for c in at.values())


def test_sets_of_one_short_name_stay_apart(spark):
    """Where first halves clash, the second halves tell sets apart."""
    sets = jaccard._named_apart(spark.createDataFrame([(5, 1, 3), (5, 2, 3), (6, 1, 3), (5, 1, 3)], "v long, w long, n int")).collect()
    assert len({r["v"] for r in sets}) == 3 and len(sets) == 4


def test_join_edges(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (3, "other words are in this one"), (None, "a b c d e f"), (None, "q r s t u v"), (9, "A B C D E F"), (4, None), (4, None), (8, "z " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x")).withColumn("v", F.lit(1))
    assert sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=repr) == plain_components(rows)
    assert jaccard.jaccard_components(df.where("false")).count() == 0


def test_null_ids_link_others(spark):
    base = [f"w{i}" for i in range(60)]
    chain = [base, base[3:] + ["p", "q", "r"], base[6:] + ["p", "q", "r", "s", "t", "u"]]
    rows = [(1, " ".join(chain[0])), (None, " ".join(chain[1])), (2, " ".join(chain[2]))]
    want = plain_components(rows)
    assert sorted(map(tuple, jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr) == want
    assert {r[2] for r in want} == {1}


def test_bounds_hold():
    rnd = random.Random(7)
    for _ in range(400):
        n = rnd.choice([1, 3, 20, 300])
        a = np.unique(np.array([rnd.getrandbits(64) for _ in range(n)], np.uint64))
        b = np.unique(np.concatenate([a[rnd.randint(0, len(a) // 2) :], np.array([rnd.getrandbits(64) for _ in range(rnd.randint(0, n))], np.uint64)]))
        apart = len(np.setxor1d(a, b))
        assert shingles.least_difference(shingles.odd_sketch(a), shingles.odd_sketch(b)) <= apart
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert 9 * apart <= len(a) + len(b)
            pa, pb = a[: jaccard.prefix_length(len(a))], b[: jaccard.prefix_length(len(b))]
            assert len(np.intersect1d(pa, pb)) >= min(jaccard.shared_prefix(len(a)), jaccard.shared_prefix(len(b)))
    assert all(1 <= jaccard.prefix_length(n) <= n for n in range(1, 3000))


def test_shingles_equal_their_words():
    assert len(shingles.shingle_set("a b c d e f a b c d e f")) == 6
    assert (shingles.shingle_set("A b\x0bC d E f") == shingles.shingle_set("a b c d e F")).all()
    assert len(shingles.shingle_set("a b")) == 1 and not len(shingles.shingle_set(" \n"))
    assert shingles.shingle_set("a b")[0] != shingles.shingle_set("b a")[0]


def test_connected_components(spark):
    rnd = random.Random(5)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 200 + i) for i in range(50)] + [(rnd.randint(300, 400), rnd.randint(300, 400)) for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["v"]: r["c"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: find(v) for v in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _plain_topk(rows, queries, k):
    out = set()
    for qid, q in queries:
        found = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i is not None and v is not None and i != qid and len(v) == len(q))
        out |= {(qid, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])}
    return out


@pytest.mark.parametrize("kind", ["random", "ties", "large", "one", "sparse"])
def test_topk_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rnd = random.Random(kind)
    dims = 1 if kind == "one" else 6
    draw = {"random": lambda: rnd.randint(-99, 99), "ties": lambda: rnd.randint(-1, 1), "large": lambda: rnd.randint(-(2**29), 2**29), "one": lambda: rnd.randint(-5, 5), "sparse": lambda: rnd.choice([0] * 9 + [rnd.randint(-50, 50)])}[kind]
    rows = [(i, [draw() for _ in range(dims)]) for i in range(200)]
    rows += [(200 + i, rows[0][1]) for i in range(80)] + [(300, None), (None, rows[0][1]), (301, [1] * (dims + 1)), (302, [2] * (dims + 1))]
    queries = [r for r in rows if r[0] is not None and r[0] % 20 == 0 and r[1] is not None] + [rows[-2]]
    schema = "vec_id long, components array<long>"
    got = topk.topk_search(spark.createDataFrame(rows, schema), spark.createDataFrame(queries, schema), 5)
    assert sorted(map(tuple, got.collect())) == sorted(_plain_topk(rows, queries, 5))


@pytest.mark.parametrize("data", ["skewed", "embeddings"])
def test_lists_stop_early_and_exactly(data):
    if data == "skewed":
        rng = np.random.default_rng(2)
        c = rng.integers(-9, 9, size=(3000, 4)).astype(float)
        c[:10] *= 50
    else:
        path = "/root/testdata/sf0.1/embeddings.parquet"
        if not os.path.exists(path):
            pytest.skip("no test data")
        import pyarrow.parquet as pq

        c = np.floor(256 * np.array(pq.read_table(path).sort_by("vec_id").column("embedding").to_pylist(), dtype=float))
    ids = np.arange(len(c))
    reads = []
    found = topk.lists_topk(c[::50], ids[::50], c, ids, 3, reads=reads)
    # every query leaves entries unread
    assert len(reads) == len(c[::50]) and max(reads) < c.size
    for row, q in enumerate(c[::50]):
        s = c @ q
        want = [i for i in np.lexsort((ids, -s)) if i != 50 * row][:3]
        assert [(x[1], x[2]) for x in found if x[0] == row] == [(int(i), int(s[i])) for i in want]


def test_topk_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, components array<long>")
    assert topk.topk_search(empty, empty, 5).count() == 0
    df = spark.createDataFrame([(1, [0.5, None]), (2, None), (3, [float("nan")]), (4, [float("inf"), 1.0]), (5, [-0.001, 0.999]), (6, [1e30])], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["c"] for r in df.select("vec_id", topk.whole_components().alias("c")).collect()}
    assert got == {1: None, 2: None, 3: None, 4: None, 5: [-1, 255], 6: [float(np.float32(1e30)) * 256]}


@pytest.mark.parametrize("groups", [(1, 3), (2, 2), (9, 50)])
def test_queries_are_never_broadcast(spark, monkeypatch, groups):
    """The queries, once for each group of candidates, grow with the square of the input; the driver must not hold them."""
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    monkeypatch.setattr(topk, "GROUPS", groups[0], raising=False)
    monkeypatch.setattr(topk, "CELL", groups[1], raising=False)
    rnd = random.Random(9)
    rows = [(i, [rnd.randint(-30, 30) for _ in range(5)]) for i in range(400)]
    schema = "vec_id long, components array<long>"
    got = topk.topk_search(spark.createDataFrame(rows, schema), spark.createDataFrame(rows[::10], schema), 5)
    assert sorted(map(tuple, got.collect())) == sorted(_plain_topk(rows, rows[::10], 5))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_bars_of_earlier_blocks_stop_reading_earlier():
    rng = np.random.default_rng(6)
    c = rng.integers(-99, 99, size=(6000, 16)).astype(float)
    ids, q = np.arange(len(c)), c[:40]
    bars = np.sort(q @ c[3000:].T, axis=1)[:, -5]
    free, barred = [], []
    want = topk.lists_topk(q, ids[:40] + 10**6, c[:3000], ids[:3000], 5, reads=free)
    got = topk.lists_topk(q, ids[:40] + 10**6, c[:3000], ids[:3000], 5, reads=barred, bars=bars, first=0.25)
    assert sum(barred) < sum(free)
    assert {x for x in want if x[2] >= bars[x[0]]} == {x for x in got if x[2] >= bars[x[0]]}


def test_repeated_query_rows_are_answered_each(spark):
    rows = [(10, [1, 0]), (10, [1, 0]), (10, [0, 1]), (6, [9, 1]), (13, [5, 2]), (13, [5, 2]), (20, [1, 1])]
    df = spark.createDataFrame(rows, "vec_id long, components array<long>")
    got = topk.topk_search(df, df.where("vec_id = 10"), 3).collect()
    one = [(10, 1, 6, 9), (10, 2, 13, 5), (10, 3, 13, 5)]
    other = [(10, 1, 13, 2), (10, 2, 13, 2), (10, 3, 6, 1)]
    assert sorted(map(tuple, got)) == sorted(one + one + other)


def test_scores_beyond_long_are_ranked(spark):
    big = float(4 * 10**12)
    rows = [(0, [big, big]), (1, [big, big + 256]), (2, [big, big]), (3, [-big, 1.0]), (4, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, components array<double>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in topk.topk_search(df, df.where("vec_id = 0"), 5).orderBy("rank").collect()]
    assert got == [(1, 1, None), (2, 2, None), (3, 4, 2 * int(big)), (4, 3, None)]


def test_op9_equals_sql(spark, tmp_path):
    import duckdb

    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(8)], 0) for i in range(400)] + [(400, None, 1), (401, [float("nan")] * 8, 1), (450, [0.5, None], 1), (451, [0.25], 1), (None, [0.5] * 8, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = con.sql(topk.OP9_SQL).fetchall()
    got = topk.op9_sorted_list_topk(spark, str(tmp_path))
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 40


def _table(rnd, n=600):
    return [(i, rnd.choice("aaaabc"), rnd.choice(["x", "y", None]), rnd.choice("pq"), rnd.randint(1, 50)) for i in range(n)]


SCHEMA = "doc_id long, source string, lang string, topic string, words long"
DIMS = ["source", "lang", "topic"]


@pytest.mark.parametrize("cells", [50_000, 0])
def test_raking_meets_the_margins(spark, cells):
    rows = _table(random.Random(6))
    df = spark.createDataFrame(rows, SCHEMA)
    targets = {"source": {"a": 0.2, "b": 0.5, "c": 0.3}, "lang": 0.5, "topic": {"p": 0.4}}
    out = raking.mix(df, df, DIMS, "words", targets, driver_cells=cells).collect()
    total = sum(r[4] for r in rows)
    share = defaultdict(float)
    for r in out:
        for d in DIMS:
            share[d, r[d]] += r["weight"] * r["words"] / total
    assert share["source", "b"] == pytest.approx(0.5, abs=1e-6) and share["topic", "q"] == pytest.approx(0.6, abs=1e-6)
    raw = {v: sum(r[4] for r in rows if r[2] == v) / total for v in ("x", "y", None)}
    want = {v: x**0.5 / sum(y**0.5 for y in raw.values()) for v, x in raw.items()}
    assert all(share["lang", v] == pytest.approx(want[v], abs=1e-6) for v in want)
    assert max(r["probability"] for r in out) == pytest.approx(1.0)
    assert all(r["probability"] == pytest.approx(r["weight"] / max(x["weight"] for x in out)) for r in out)


def test_raking_equals_plain_fitting():
    """Against a dense array that is scaled margin by margin."""
    rng = np.random.default_rng(8)
    dense = rng.integers(1, 50, size=(3, 4, 2)).astype(float)
    goals = [rng.dirichlet(np.ones(k)) for k in dense.shape]
    want = dense / dense.sum()
    for _ in range(500):
        for axis, goal in enumerate(goals):
            other = tuple(i for i in range(3) if i != axis)
            shape = [1, 1, 1]
            shape[axis] = -1
            want = want * (goal / want.sum(other)).reshape(shape)
    cells = list(np.ndindex(*dense.shape))
    got, error = raking.raked(cells, [dense[c] for c in cells], [dict(enumerate(g)) for g in goals])
    assert error < 1e-8 and np.allclose(got, [want[c] * dense.sum() / dense[c] for c in cells])


@pytest.mark.parametrize("cells", [50_000, 0])
def test_contradicting_targets_show(spark, cells):
    # each source has one language, so their shares cannot differ
    df = spark.createDataFrame([(i, "ab"[i % 2], "xy"[i % 2], 10) for i in range(20)], "doc_id long, source string, lang string, words long")
    out = raking.mix(df, df, ["source", "lang"], "words", {"source": {"a": 0.2, "b": 0.8}, "lang": {"x": 0.7, "y": 0.3}}, driver_cells=cells).collect()
    assert {round(r["margin_error"], 6) for r in out} == {0.5}
    assert {r["margin_error"] < 1e-9 for r in raking.mix(df, df, ["source"], "words", {"source": {"a": 0.2, "b": 0.8}}, driver_cells=cells).collect()} == {True}


def test_both_ways_of_raking_agree(spark):
    df = spark.createDataFrame(_table(random.Random(8), 200), SCHEMA)
    a, b = ({r["doc_id"]: r["weight"] for r in raking.mix(df, df, DIMS, "words", {}, driver_cells=c).collect()} for c in (50_000, 0))
    assert a == pytest.approx(b)


def test_sampling_follows_the_probabilities(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"), F.lit(10).cast("long").alias("words"))
    out = raking.mix(df, df, ["source"], "words", {"source": {"a": 0.5, "b": 0.5}}, key=["doc_id"])
    drawn = {r["source"]: r["n"] for r in out.where("sampled = 1").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert drawn["a"] == 5000 and abs(drawn["b"] - 5000) < 300


@pytest.mark.parametrize("hashes", [1000, 0])
def test_null_and_repeated_ids_have_lots_of_their_own(spark, monkeypatch, hashes):
    """Rows of null id, of one id with many texts, and equal rows are each drawn with their probability, within 3 sigma."""
    monkeypatch.setattr(raking, "BROADCAST_HASHES", hashes)
    kinds = {"none": "CAST(NULL AS LONG)", "one": "CAST(7 AS LONG)", "own": "id"}
    parts = [spark.range(4000).selectExpr(f"{v} AS doc_id", f"concat('{k} ', id) AS text", "'b' AS source", "10L AS words") for k, v in kinds.items()]
    parts.append(spark.range(4000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'same' AS text", "'b' AS source", "10L AS words"))
    parts.append(spark.range(2000).selectExpr("id AS doc_id", "'rare' AS text", "'a' AS source", "10L AS words"))
    df = reduce(lambda a, b: a.unionByName(b), parts)
    out = raking.mix(df, df, ["source"], "words", {"source": {"a": 0.5, "b": 0.5}}, key=["doc_id", "text"])
    found = out.groupBy(F.split("text", " ")[0].alias("k")).agg(F.sum("sampled").alias("n"), F.first("probability").alias("p"), F.count("*").alias("of")).collect()
    assert {r["k"] for r in found} == {*kinds, "same", "rare"} and out.columns == [*df.columns, "weight", "margin_error", "probability", "sampled"]
    for r in found:
        assert abs(r["n"] - r["p"] * r["of"]) <= 3 * (r["of"] * r["p"] * (1 - r["p"])) ** 0.5, r


def test_drawn_set_is_what_the_probabilities_and_lots_say(spark):
    """The drawn rows against lots recomputed from the key, and probabilities from plain fitting."""
    df = spark.createDataFrame(_table(random.Random(9), 500), SCHEMA)
    out = raking.mix(df, df, DIMS, "words", {"source": 0.5}, key=["doc_id"]).withColumn("lot", F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(1 << 52)) / F.lit(float(1 << 52))).collect()
    cells = defaultdict(float)
    for r in out:
        cells[r["source"], r["lang"], r["topic"]] += r["words"]
    now, names = dict(cells), list(cells)
    goals = []
    for d, power in enumerate((0.5, raking.TEMPERATURE, raking.TEMPERATURE)):
        have = defaultdict(float)
        for c, t in cells.items():
            have[c[d]] += t
        raised = {v: (t / sum(have.values())) ** power for v, t in have.items()}
        goals.append({v: x / sum(raised.values()) * sum(have.values()) for v, x in raised.items()})
    for _ in range(300):
        for d in range(3):
            have = defaultdict(float)
            for c in names:
                have[c[d]] += now[c]
            now = {c: now[c] * goals[d][c[d]] / have[c[d]] for c in names}
    factor = {c: now[c] / cells[c] for c in names}
    for r in out:
        p = factor[r["source"], r["lang"], r["topic"]] / max(factor.values())
        assert r["probability"] == pytest.approx(p) and r["sampled"] == (r["lot"] < r["probability"])


def test_raking_edges(spark):
    rows = [(1, None, "x", "p", 0), (1, None, "x", "p", 0), (None, "a", None, "q", None), (3, "a", "x", "q", 5)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("weight", F.lit("mine"))
    out = raking.mix(df, df, DIMS, "words", {"source": {"a": 1.0}})
    assert out.columns == [*df.columns, "weight_", "margin_error", "probability", "sampled"] and out.count() == 4
    assert raking.mix(df.where("false"), df.where("false"), DIMS, "words", {}).count() == 0
    assert raking.mix(df.where("words = 0"), df.where("words = 0"), DIMS, "words", {}).where("sampled = 1").count() == 0


def test_topics(spark):
    rows = [("Copyright me",), ("a@b",), ("x | y",), ("f() { }",), ("short",), ("w " * 900,), ("w " * 9000,), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "text string").select(raking.topic(F.col("text"))).collect()]
    assert got == ["legal", "contact", "table", "code", "short prose", "prose", "long prose", None]


def test_region_of_unlinked_near_sets_is_left_to_one_task(spark, monkeypatch):
    """Of 1,600 sets with most shingles in common and hardly a link, Spark joins pairs with the first two levels' pivots and no more; no link is lost."""
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(240)]
    rows = []
    for i in range(1600):
        at = rnd.randrange(210)
        rows.append((i, " ".join([*base[:at], *(f"r{i}x{k}" for k in range(30)), *base[at + 30 :]])))
    rows += [(5000 + i, " ".join([*rows[i][1].split()[:-2], "other", "end"])) for i in (7, 400, 1199)]
    joined, near = [], jaccard._near

    def counted(pairs, sketches):
        joined.append(pairs.count())
        return near(pairs, sketches)

    monkeypatch.setattr(jaccard, "_near", counted)
    monkeypatch.setattr(jaccard, "FOUND", 2)
    out = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["component_id"] for r in out.collect()}
    assert [(i, c) for i, c in got.items() if c != (i - 5000 if i >= 5000 else i)] == [] and len(got) == len(rows)
    assert len(joined) == 3 and joined[2] == 0, joined


def test_shingles_of_many_texts_equal_plain_sets():
    """Texts hashed together keep their own sets, whatever their bytes; many different words cost no more than few."""
    rnd = random.Random(12)
    for _ in range(200):
        texts = ["".join(rnd.choice("ab\0 \t\nAé") for _ in range(rnd.randint(0, 60))) for _ in range(4)] + [None, "x" * 8 + " " + "x" * 9 + " y" * 3]
        sets = shingles.shingle_sets([t and t.encode() for t in texts])
        assert [len(s) for s in sets] == [len(plain_set(t)) for t in texts]
        assert all((s == shingles.shingle_set(t)).all() and (s[1:] > s[:-1]).all() for s, t in zip(sets, texts))
    long = ["q" * n for n in range(1, 400)]
    assert len(np.unique(np.concatenate(shingles.shingle_sets([w.encode() for w in long])))) == len(long)


def test_rare_shingles_are_dealt_evenly(spark, monkeypatch):
    """Prefixes hold the least hashes; their buckets are of like sizes all the same, and sets that share one are kept."""
    monkeypatch.setattr(jaccard, "BUCKET", 1000, raising=False)
    monkeypatch.setattr(jaccard, "PACKED", 3000, raising=False)
    rnd = np.random.default_rng(3)
    rows = [(i, 80, 2, np.concatenate([np.sort(rnd.integers(0, 1 << 62, 18)), [-5, -4]])) for i in range(1000)]
    rows[7][3][0] = rows[300][3][0] = 11
    df = spark.createDataFrame([(v, n, c, p.astype(np.int64).tobytes()) for v, n, c, p in rows], "v long, n int, common int, prefix binary").repartition(3)
    got = {tuple(r) for r in jaccard._seeded(df.unionByName(df)).collect()}
    assert got == {(11, 7, 80), (11, 300, 80)} | {(s, v, 80) for v in range(1000) for s in (-5, -4)}
    sizes = [r[0] for r in jaccard._packed(df, 18).groupBy("bucket").agg(F.sum(F.length("s") / 8)).select("sum((length(s) / 8))").collect()]
    assert len(sizes) == 18 and max(sizes) < 1300 and sum(sizes) == 18000
