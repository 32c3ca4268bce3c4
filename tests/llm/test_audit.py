"""The filter audit against a plain walk through every order, on rows with nulls, copies and repeats."""

import re
from collections import Counter
from itertools import permutations

import pytest

pytest.importorskip("tarmac.llm.filter_audit")

from tarmac.llm import filter_audit as fa

LONG = " ".join(f"w{i}" for i in range(200))
ROWS = [
    (5, LONG, "a"), (2, LONG, "a"), (9, LONG, None), (2, LONG, "b"), (None, LONG, "a"), (7, None, ""), (8, "", "a"),
    (10, "x " * 300, "b"), (11, "A B\tC $5", "b"), (11, "A B\tC $5", "b"), (12, LONG + " \x0b\x1fzz", "a"), (13, LONG + " #", "c"), (14, "é" * 99 + "AB", "c"), (None, None, None),
]
LABELS = [(5, 1, 0), (5, 0, 1), (9, 1, None), (7, 0, 1), (11, 1, 1), (None, 1, 1), (99, 1, 1)]


def brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, p in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        docs.append((p or "", fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            gone = []
            for k, f in enumerate(order):
                now = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                alone = sum(d[0] == part and d[1][f] and sum(d[1].values()) == 1 for d in docs)
                out[part, "".join(order), k + 1] = (len(left), len(now), sum(d[1][f] for d in gone), alone, sum(d[2] for d in now), sum(d[3] for d in now))
                shapley[part, f] += len(now)
                gone += now
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def saved(spark, path, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, _part string, A int")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_equals_every_order_walked(spark, tmp_path):
    got = fa.op11_filter_audit(spark, saved(spark, tmp_path, ROWS, LABELS)).collect()
    assert len(got) == 4 * 600  # a, b, c and the empty part, which nulls share
    assert {tuple(r) for r in got} == brute(ROWS, LABELS)


def test_no_documents(spark, tmp_path):
    assert fa.op11_filter_audit(spark, saved(spark, tmp_path, [], [])).count() == 0


def test_survivors_and_total(spark):
    schema = "part string, A boolean, B boolean, docs long, good long, toxic long"
    cells = spark.createDataFrame([("p", True, False, 3, 1, 0), ("p", False, False, 2, 0, 2), ("q", True, True, 5, 0, 0)], schema)
    got = {(r["part"], r["subset"]): (r["docs"], r["good"], r["toxic"]) for r in fa.survivors(cells, "AB").collect()}
    assert got == {("p", 0): (5, 1, 2), ("p", 1): (2, 0, 2), ("p", 2): (5, 1, 2), ("p", 3): (2, 0, 2), ("q", 0): (5, 0, 0), (None, 0): (10, 1, 2), (None, 1): (2, 0, 2), (None, 2): (5, 1, 2), (None, 3): (2, 0, 2)}
    all_of = fa.audit(cells, "AB")
    assert all_of.count() == 3 * 4 and {(r["part"], r["kept"]) for r in all_of.where("filter_order = 'AB' AND step = 2").collect()} == {("p", 2), ("q", 0), (None, 2)}


def test_only_documents_multiply_no_grouping_sets(spark, tmp_path):
    """The CUBE's Expand stands over the cells that were written, and no plan has a cartesian product."""
    df = fa.op11_filter_audit(spark, saved(spark, tmp_path, ROWS, LABELS))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
