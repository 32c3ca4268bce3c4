"""Cases in which an operator once did less than its whole job."""

from collections import defaultdict

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from tarmac.llm import jaccard, raking, tokens


def test_mixture_weighs_ids_of_the_vocabulary(spark, tmp_path):
    texts = {"en": "the house is old", "de": "Donaudampfschifffahrtsgesellschaft Bundesausbildungsförderungsgesetz", "xx": "x9" * 300}
    rows = [(i, lang, f"s{i % 2}", texts[lang] + f" {i}") for i in range(40) for lang in texts] + [(None, "en", "s0", None)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    t = Tokenizer.from_file(tokens.tokenizer_path())
    out = raking.op10_raked_mixture(spark, str(tmp_path)).collect()
    ids = defaultdict(list)
    for i, lang, _, text in rows:
        ids[i, lang].append(len(t.encode(text or "", add_special_tokens=False).ids))
    assert all(r["n_tokens"] in ids[r["doc_id"], r["lang"]] for r in out) and len(out) == len(rows)
    total = sum(r["n_tokens"] for r in out)
    have, got = defaultdict(float), defaultdict(float)
    for r in out:
        have[r["lang"]] += r["n_tokens"] / total
        got[r["lang"]] += r["n_tokens"] * r["weight"] / total
    raised = {v: x**raking.TEMPERATURE for v, x in have.items()}
    assert {v: x / sum(raised.values()) for v, x in raised.items()} == pytest.approx(got, abs=1e-6)
    # the pipeline's stage draws the same
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    drawn = corpus_pipeline.mixture(spark, docs, str(tmp_path)).collect()
    assert sorted(repr((r["doc_id"], r["lang"])) for r in drawn) == sorted(repr((r["doc_id"], r["lang"])) for r in out if r["sampled"])


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_near_copies_choose_rows_whatever_their_ids(spark, monkeypatch, broadcast):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", broadcast)
    text = {x: " ".join(f"{x}{i}" for i in range(60)) for x in "XYZWN"}
    near = text["X"] + " more"
    rows = [(3, text["X"], "a"), (3, text["Y"], "a"), (9, text["X"], "a"), (None, text["X"], "a"), (None, near, "a")]
    rows += [(3, near, "b"), (5, text["Z"], "b"), (5, text["Z"], "a"), (None, text["N"], "b"), (None, text["N"], "a"), (None, text["W"], "a")]
    rows += [(4, None, "a"), (4, None, "b"), (6, " ", "a"), (None, "", "a"), (None, None, "a")]
    want = [(3, "Y", "a"), (5, "Z", "a"), (None, "N", "a"), (None, "W", "a"), (4, None, "a"), (6, " ", "a"), (None, "", "a"), (None, None, "a")]
    key = lambda r: repr((r[0], r[1] and r[1][:1], r[2]))
    found = set()
    for order, parts in ((rows, 1), (rows[::-1], 3)):
        docs = spark.createDataFrame(order, "doc_id long, text string, _id string").repartition(parts)
        kept = corpus_pipeline.near_copies(spark, docs, "")
        assert kept.columns == docs.columns
        got = sorted(map(tuple, kept.collect()), key=repr)
        found.add(repr(got))
        # of X and its near copy, one row of id 3
        xs = [r for r in got if r[1] and r[1].startswith("X")]
        assert len(xs) == 1 and xs[0][0] == 3
        assert sorted(map(key, (r for r in got if r not in xs))) == sorted(map(repr, want))
    assert len(found) == 1
