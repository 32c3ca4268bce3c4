"""From documents to packed training windows: five stages, each written and read again before the next.

Toxic and poor documents go, one document of each group of near copies stays, the rest is drawn to the
target mixture, and what is drawn is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.jaccard import one_row_of_each
from tarmac.llm.packing import pack
from tarmac.llm.quality import fit_quality, with_posteriors
from tarmac.llm.raking import described, mix, targets, topical
from tarmac.llm.storage import dropped, free_name, written
from tarmac.llm.toxicity import fit_toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose clauses the grammar does not find toxic.

    Rows are judged one by one, so null, repeated and tied ids are no matter; a null or empty text has no clause and
    stays. Without documents or labels of both kinds the prior weights judge.
    """
    name = free_name(docs.columns, "_toxicity")
    scored = fit_toxicity(docs, _labels(spark, sf_dir)).score(docs, score_col=name)
    return scored.where(F.col(name) < 0.5).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely good than not, given their text, host and path.

    Rows are judged one by one; of repeated rows each counts as evidence for its site. A null source or language is a
    site of its own, a null text is empty, a score of exactly 0.5 stays, and an empty table stays empty.
    """
    model = fit_quality(docs, _labels(spark, sf_dir))
    p, h, s, q = (free_name(docs.columns, x) for x in ("_quality", "_host_posterior", "_path_posterior", "_score"))
    known = written(model.probability(docs, out_col=p))  # texts are read by the classifier once
    judged = with_posteriors(known, known, p, "source", "lang", (h, s, q))
    return judged.where(F.col(q) >= 0.5).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, whatever the ids."""
    return one_row_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics have their target shares of the tokens.

    Each row has its own lot: null and repeated ids, and repeated rows, are drawn like others. Null sources and languages
    are values of their own; an empty table stays empty.
    """
    evidence, _, ids = described(docs, ["source", "lang"])
    known, kind = topical(docs)
    drawn = mix(known, evidence, ["source", "lang", kind], ids, targets(kind), key=["doc_id", "text"])
    return drawn.where(F.col(drawn.columns[-1]) == 1).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn documents in windows of 2048 ids. A null or empty text is its end id alone; repeated rows are packed each; no rows give no windows."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_copies", near_copies), ("mixture", mixture), ("packing", packing)]
#: The learned stages and the tokenizer cannot be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents. A stage's table goes once the next one is written; the last one's input stays, as the result reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
