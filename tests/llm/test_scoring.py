"""Toxicity and quality: the grammar, what is learned, and accuracy on held-out rows."""

import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.llm import logistic, quality, toxicity

DATA, SMALL = "/root/testdata/sf0.1", "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
LEXICON = {"idiot$": 4.0, "lowei": 3.0}


def scored(text):
    return toxicity.Scorer(LEXICON).clauses(text)


def test_clauses_and_spans():
    text = "All is well. You are an IDIOT, you know! Nothing here"
    ((a, b, score, pattern),) = scored(text)
    assert text[a:b] == " You are an IDIOT, you know" and pattern == "YIY"
    assert score == pytest.approx(4.0)
    assert scored("") == [] and scored("idiotic things") == []


def test_stems_and_words():
    assert [c[3] for c in scored("x loweischaft y")] == ["I"]
    assert scored("xlowei") == []


ALONE, REPORTED, NEGATED, BARE = 0.7, 0.6, 0.4, 0.4


@pytest.mark.parametrize(
    ("text", "pattern", "score"),
    [
        ("this is an idiot", "I", 4 * ALONE),
        ("idiot that you are", "IY", 4.0),
        ("this is not an idiot", "Ni", 4 * NEGATED * ALONE),
        ("not one two three four five idiot", "NI", 4 * ALONE),
        ("they said he is an idiot", "RJ", 4 * REPORTED * ALONE),
        ("they said he is not an idiot", "RNj", 4 * NEGATED * REPORTED * ALONE),
        ("I will kill you", "TY", 1.0),
        ("they kill you", "TY", BARE),
        ("ich werde dich umbringen", "YT", 1.0),
        ("they said I will kill you", "RKY", REPORTED),
        ("He said you are an idiot", "RYJ", 4 * REPORTED),
        ("He said: you are an idiot", "RYJ", 4 * REPORTED),
        ("Er schrieb: du bist idiot", "RYJ", 4 * REPORTED),
        ('He said: "you are an idiot" and you are an idiot', "RYJYI", 4 * REPORTED + 4),
        ('He wrote "you idiot', "RYJ", 4 * REPORTED),
        ("idiot said", "IR", 4 * ALONE),
    ],
)
def test_composition(text, pattern, score):
    ((_, _, got, read),) = scored(text)
    assert read == pattern and got == pytest.approx(score)


def test_quotations_go_on_into_the_next_sentence():
    text = 'She said: "You are wrong. You are an idiot." You are an idiot.'
    assert [(c[3], c[2]) for c in scored(text)] == [("YJ", pytest.approx(4 * REPORTED)), ("YI", pytest.approx(4.0))]
    assert [c[3] for c in scored('She said: "You are wrong.\nYou are an idiot.')] == ["YI"]


def test_best_path_equals_all_paths():
    """Random strings through every path of the four transducers in turn, none composed."""
    rnd, whole = random.Random(1), toxicity.grammar()
    parts = [whole.first.first.first, whole.first.first.second, whole.first.second, whole.second]

    def paths(machine, line):
        found = [(machine.start, [])]
        for symbol, weight in line:
            found = [(to, [*made, (out, weight * f)]) for at, made in found for to, out, f in machine.steps(at, symbol)]
        return [made for at, made in found if machine.accepts(at)]

    for _ in range(600):
        symbols = [(s, float(rnd.randint(1, 9)) if s in "IT" else 0.0) for s in rnd.choices("ITYNRPCQO", k=rnd.randint(0, 8))]
        lines = [symbols]
        for machine in parts:
            lines = [out for line in lines for out in paths(machine, line)]
        totals = [(sum(w for s, w in line if s in toxicity.ATTACKS), "".join(s for s, _ in line if s not in "OPCQ")) for line in lines]
        best = min(totals, key=lambda x: (-round(x[0], 9), x[1]))
        got = toxicity.best_path(whole, whole.start, symbols)
        assert got[0] == pytest.approx(best[0]) and got[1] in {m for t, m in totals if t == pytest.approx(best[0])}


def test_choice_of_terms(spark):
    long = "x" * 300 + "$"
    counts = [("trash$", 50, 0), ("trash", 50, 0), ("tra", 50, 0), ("low", 40, 0), ("lowei", 40, 0), ("loweia", 10, 0), ("réeux", 20, 60), ("réeuxa", 15, 0), ("the$", 90, 900), ("odd$", 2, 0), (long, 30, 0), (None, 100, 1000)]
    kept = toxicity.with_evidence(spark.createDataFrame(counts, "term string, pos long, neg long"), 100, 1000).collect()
    assert {r["term"]: r["odds"] for r in kept}["lowei"] == pytest.approx(np.log(40.25 / 100.5) - np.log(0.25 / 1000.5))
    found = toxicity.choose_terms([tuple(r) for r in kept])
    assert {"trash$", "lowei", long} <= set(found) and not {"tra", "low", "the$", "odd$", "loweia"} & set(found)


def test_terms_are_counted_whole(spark):
    long = "y" * 200
    rows = [(1, f"Alpha beta {long}"), (0, "alpha alpha"), (1, None), (0, "")]
    got = {r["term"]: (r["pos"], r["neg"]) for r in toxicity.term_counts(spark.createDataFrame(rows, "l int, t string")).collect()}
    assert got["alpha$"] == (1, 1) and got["alp"] == (1, 1) and got[long + "$"] == (1, 0) and got["beta"] == (1, 0) and got[None] == (2, 2)


def test_repeated_ids_do_not_widen_the_sample(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert sorted(map(tuple, toxicity.labelled_sample(docs, labels, "toxic", ["text"], 10).collect())) == [(0, "c"), (1, "a")]


def test_logistic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < logistic.sigmoid(2 * x[:, 0] - x[:, 1] + 0.5)).astype(float)
    w = logistic.fit(x, y, np.zeros(3), np.full(3, 0.1))
    assert np.abs(w - [2, -1, 0.5]).max() < 0.25
    assert logistic.fit(np.zeros((0, 2)), np.zeros(0), np.ones(3), np.ones(3)).tolist() == [1, 1, 1]


def _auc(rows):
    rows = sorted(rows)
    ranks, i = {}, 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][0] == rows[i][0]:
            j += 1
        ranks[rows[i][0]] = (i + j + 1) / 2
        i = j
    pos = [ranks[s] for s, y in rows if y]
    return (sum(pos) - len(pos) * (len(pos) + 1) / 2) / (len(pos) * (len(rows) - len(pos)))


@needs_data
def test_toxicity_on_held_out_rows(spark):
    out = toxicity.op2_clause_grammar_toxicity(spark, DATA)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    for r in rows[:200]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    test = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in test) / len(test) > 0.97
    assert sum(r["predicted"] for r in test if not r["toxic"]) / len(test) < 0.01
    assert _auc([(r["score"], r["toxic"]) for r in test]) > 0.9
    assert out.count() == 10000


@needs_data
def test_quality_on_held_out_rows(spark):
    rows = quality.op6_site_shrunk_quality(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.98


@pytest.fixture
def docs(spark):
    rows = [(1, "You idiot.", "a", "en", 9), (1, "You idiot.", "a", "en", 9), (None, None, None, None, 0), (3, "", "a", "en", 1), (4, "word " * 200_000, "b", "en", 2), (5, "fine day", "b", None, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, toxicity int")


def test_edges_of_toxicity(spark, docs):
    model = toxicity.ToxicityModel(LEXICON, toxicity.PRIOR)
    got = model.score(docs, spans_col="clauses")
    assert got.columns == [*docs.columns, "toxicity_", "clauses"]
    by = {r["doc_id"]: r["toxicity_"] for r in got.collect()}
    assert by[1] > 0.5 > by[3] == by[None] and by[4] < 0.5
    assert model.score(docs.where("false")).count() == 0
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    empty = toxicity.fit_toxicity(docs, labels)
    assert empty.lexicon == {} and empty.weights == toxicity.PRIOR


def test_only_learnable_labels_count(spark):
    """Held-out labels do not change the model."""
    rows = [(i, ("bad scumword here " if i % 3 == 0 else "good text here ") * 3) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit_toxicity(docs, labels), toxicity.fit_toxicity(docs, flipped)
    assert a == b and any("scum" in t for t in a.lexicon)


def test_edges_of_quality(spark, docs):
    model = quality.QualityModel([0.0] * 10, [1.0] * 10, [0.0] * 9 + [1.0, 0.5])
    p = model.probability(docs, out_col="p")
    assert p.columns[-1] == "p" and p.count() == 6
    out = quality.with_posteriors(p, p, "p", "source", "lang").collect()
    assert len(out) == 6 and all(0 < r["score"] < 1 for r in out)
    assert quality.with_posteriors(p.where("false"), p.where("false"), "p", "source", "lang").count() == 0
    assert quality.fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int")).weights == [0.0] * 10 + [2.0]


def _plain_posteriors(rows):
    """Of (id, host, path, p): host posterior, path posterior and score of each row, and the corpus mean, row by row."""

    def rate(group):
        return sum(r[3] for r in group), len(group)

    total, n = rate(rows)
    m = total / n
    hosts = {h: rate([r for r in rows if r[1] == h]) for h in {r[1] for r in rows}}
    paths = {k: rate([r for r in rows if (r[1], r[2]) == k]) for k in {(r[1], r[2]) for r in rows}}
    kh = quality._strength(sum(c * (s / c - m) ** 2 for s, c in hosts.values()), m, n, sum(c * c for _, c in hosts.values()), len(hosts))
    q = sum(c * (s / c - hosts[k[0]][0] / hosts[k[0]][1]) ** 2 for k, (s, c) in paths.items())
    kp = quality._strength(q, m, n, sum(c * c for _, c in paths.values()), len(paths) - len(hosts) + 1)
    bound = lambda x: max(1e-6, min(1 - 1e-6, x))
    logit = lambda x: math.log(bound(x) / (1 - bound(x)))
    out = []
    for _, host, path, p in rows:
        (sh, nh), (sp, np_) = hosts[host], paths[host, path]
        th = (kh * m + sh - p) / (kh + nh - 1)
        tp = (kp * th + sp - p) / (kp + np_ - 1)
        out.append((bound(th), bound(tp), 1 / (1 + math.exp(-(logit(p) + logit(tp) - logit(m))))))
    return out, m


def test_posteriors_equal_their_formula(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, f"h{min(i % 13, 9)}", f"p{i % 3}", rng.random() if i % 13 else 0.05) for i in range(400)] + [(900, "lonely", None, 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, p double")
    want, m = _plain_posteriors(rows)
    for bound in (20_000, 0):
        monkeypatch.setattr(quality, "BROADCAST_SITES", bound)
        got = quality.with_posteriors(df, df, "p", "source", "lang").orderBy("doc_id").collect()
        for r, w in zip(got, want, strict=True):
            assert (r["host_posterior"], r["path_posterior"], r["score"]) == pytest.approx(w)
        # a site of one document says no more than the corpus
        assert got[-1]["path_posterior"] == pytest.approx(m) and got[-1]["score"] == pytest.approx(0.5)


@needs_data
def test_whole_quality_query_equals_plain_rows(spark):
    """Every row of the query, from the features of its text in plain Python to the score."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    texts = sorted((r["doc_id"], r["source"], r["lang"], r["text"]) for r in docs.collect())
    rows = []
    for i, source, lang, text in texts:
        z = model.weights[-1] + sum(w * (x - a) / b for w, x, a, b in zip(model.weights, quality.text_features(text or ""), model.mean, model.scale, strict=False))
        rows.append((i, source, lang, 1 / (1 + math.exp(-z))))
    want, _ = _plain_posteriors(rows)
    got = quality.op6_site_shrunk_quality(spark, SMALL).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    for r, row, w in zip(got, rows, want, strict=True):
        assert (r["doc_score"], r["host_posterior"], r["path_posterior"], r["score"]) == pytest.approx((row[3], *w), rel=1e-6, abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


@needs_data
def test_whole_toxicity_query_equals_plain_rows(spark):
    """The terms' evidence is recounted from two-by-two tables of the learned rows, and every score follows from the clauses of its text alone."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    sides = [[toxicity._terms(texts[i]) for i, y in toxic.items() if (y > 0) == side] for side in (True, False)]
    n = [len(s) for s in sides]
    evidence = []
    for term in set().union(*sides[0]):
        seen = [sum(term in t for t in s) for s in sides]
        odds = math.log((seen[0] + 0.25) / (n[0] + 0.5)) - math.log((seen[1] + 0.25) / (n[1] + 0.5))
        table = [(seen[0], n[0], sum(seen)), (seen[1], n[1], sum(seen)), (n[0] - seen[0], n[0], sum(n) - sum(seen)), (n[1] - seen[1], n[1], sum(n) - sum(seen))]
        g2 = sum(2 * o * math.log(o * sum(n) / (row * column)) for o, row, column in table if o)
        if seen[0] >= toxicity.LEAST_ROWS and odds >= toxicity.LEAST_ODDS and g2 >= toxicity.least_g2(n[0]):
            evidence.append((term, seen[0], odds))
    model = toxicity.fit_toxicity(docs, labels)
    assert model.lexicon == pytest.approx(toxicity.choose_terms(evidence)) and model.lexicon
    scorer = toxicity.Scorer(model.lexicon)
    got = {r["doc_id"]: r for r in toxicity.op2_clause_grammar_toxicity(spark, SMALL).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        z = model.weights[-1] + sum(w * x for w, x in zip(model.weights, toxicity.document_features(scorer.clauses(text), len(text)), strict=False))
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-z))) and got[i]["predicted"] == int(got[i]["score"] >= 0.5)
