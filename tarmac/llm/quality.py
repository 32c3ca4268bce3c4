"""Document quality with hierarchical empirical Bayes over hosts and paths.

A classifier of the text gives each document a probability. Its sums by host and by path are the
evidence of beta-binomial posteriors: a path is shrunk toward its host and a host toward the whole
corpus, each with a strength estimated from how far sites differ beyond chance. A document's score is
its own log odds, moved by how far its path's posterior lies from the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.batches import mapped, slices
from tarmac.llm.storage import dropped, free_name, written
from tarmac.llm.toxicity import held_out, labelled_sample

#: Labelled rows that the classifier is learned from, at most (those of the lowest hash).
TRAIN_ROWS = 20_000
#: Site rows that may be broadcast (some 60 bytes each); more are joined by shuffle.
BROADCAST_SITES = 20_000
SYMBOLS = "#$%&*^~|<>{}[]=+_\\/@"
NAMES = ("repeats", "upper", "symbols", "bars", "bangs", "digits", "variety", "word_length", "marks", "length")
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e6


def text_features(text: str) -> list[float]:
    """Shares of repeated, upper-case and symbol-laden words, variety of words, and lengths, of a whole text."""
    from operator import eq

    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(NAMES)
    root = lambda k, of: math.sqrt(min(1.0, k / of))
    return [
        root(sum(map(eq, words, words[1:])), n),
        root(sum(map(str.isupper, words)), n),
        root(sum(map(text.count, SYMBOLS)), chars),
        root(text.count("|"), n),
        root(text.count("!"), n),
        root(sum(map(text.count, "0123456789")), chars),
        math.log1p(len(set(words))) / math.log1p(n),
        min(chars / n, 40) / 10,
        root(sum(map(text.count, ".,;:?")), n),
        math.log1p(n) / 10,
    ]


@dataclass
class QualityModel:
    mean: list[float]
    scale: list[float]
    weights: list[float]

    def probability(self, df: DataFrame, text_col: str = "text", out_col: str = "quality", keep_text: bool = True) -> DataFrame:
        """``df`` with the classifier's probability that the whole text is good. A null or empty text has features of 0."""
        import pyarrow as pa

        name = free_name(df.columns, out_col)
        at = df.columns.index(text_col)
        use = [i for i, c in enumerate(df.columns) if keep_text or i != at]
        schema = T.StructType([*(df.schema.fields[i] for i in use), T.StructField(name, T.DoubleType())])
        names = [df.columns[i] for i in use] + [name]
        mean, scale, weights = self.mean, self.scale, self.weights

        def run(batches: Iterator) -> Iterator:
            import numpy as np

            from tarmac.llm.logistic import sigmoid

            for b in slices(batches):
                x = np.array([text_features(t or "") for t in b.column(at).to_pylist()]).reshape(-1, len(NAMES))
                z = ((x - mean) / scale) @ np.array(weights[:-1]) + weights[-1]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in use), pa.array(sigmoid(z), pa.float64())], names)

        return mapped(df, run, schema)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, label: str = "quality") -> QualityModel:
    """The classifier, from at most ``rows`` labelled rows that are not held out; without any, every text is good."""
    import numpy as np

    from tarmac.llm.logistic import fit

    def features(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches):
            x = [text_features(t or "") for t in b.column(1).to_pylist()]
            y = [float(v > 0) for v in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in x], pa.float64()) for i in range(len(NAMES))), pa.array(y, pa.float64())], [*NAMES, "y"])

    sample = labelled_sample(docs, labels, label, ["text"], rows)
    found = mapped(sample, features, ", ".join(f"{c} double" for c in (*NAMES, "y"))).collect()
    k = len(NAMES)
    data = np.array(sorted(map(tuple, found)), dtype=float).reshape(-1, k + 1)
    x, y = data[:, :k], data[:, k]
    mean = x.mean(0) if len(x) else np.zeros(k)
    scale = np.maximum(x.std(0), 1e-3) if len(x) else np.ones(k)
    prior = np.array([0.0] * k + [2.0])
    weights = fit((x - mean) / scale, y, prior, np.array([0.5] * k + [0.05]))
    return QualityModel(*([float(v) for v in a] for a in (mean, scale, weights)))


def _strength(q: float, m: float, n: float, n2: float, groups: float) -> float:
    """Prior observations by moments: the spread of group rates about their mean beyond that of chance."""
    v = m * (1 - m)
    room = n - n2 / n if n else 0.0
    if v <= 0 or room <= 0:
        return MOST_STRENGTH
    between = (q - (groups - 1) * v) / room
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, v / between - 1)) if between > 0 else MOST_STRENGTH


def with_posteriors(df: DataFrame, evidence: DataFrame, p_col: str, host: str, path: str, names: tuple[str, str, str] = ("host_posterior", "path_posterior", "score")) -> DataFrame:
    """``df`` with the posteriors of its host and path, without its own evidence, and the combined score, as its last three columns.

    A name that ``df`` has gets trailing underscores.

    ``evidence`` has host, path and ``p_col`` of every document (``df`` itself, or what it was made from).
    Null hosts and paths are sites of their own. Sites are aggregated where their rows lie before they are
    shuffled, so a host with a third of all rows is one row of each task.
    """
    free: list[str] = []
    for x in names:
        free.append(free_name([*df.columns, *free], x))
    paths = written(evidence.groupBy(F.col(host).alias("_host"), F.col(path).alias("_path")).agg(F.sum(p_col).alias("_sp"), F.count(p_col).alias("_np")))
    hosts = paths.groupBy("_host").agg(F.sum("_sp").alias("_sh"), F.sum("_np").alias("_nh"))
    sites = paths.alias("p").join(hosts.alias("h"), F.col("p._host").eqNullSafe(F.col("h._host"))).select("p.*", "_sh", "_nh")
    g = hosts.agg(F.sum("_sh"), F.sum("_nh"), F.sum(F.col("_nh") * F.col("_nh")), F.count("*")).first()
    total, n, n2, groups = (float(v or 0) for v in g)
    m = min(1 - 1e-6, max(1e-6, total / n)) if n else 0.5
    spread = lambda s, k, about: F.sum(F.col(k) * F.pow(F.col(s) / F.col(k) - about, 2))
    qh = hosts.where("_nh > 0").agg(spread("_sh", "_nh", F.lit(m))).first()[0] or 0.0
    s = sites.where("_np > 0").agg(spread("_sp", "_np", F.col("_sh") / F.col("_nh")), F.sum("_np"), F.sum(F.col("_np") * F.col("_np")), F.count("*")).first()
    k_host = _strength(qh, m, n, n2, groups)
    k_path = _strength(s[0] or 0.0, m, float(s[1] or 0), float(s[2] or 0), float(s[3]) - groups + 1)

    small = paths.count() <= BROADCAST_SITES
    same = F.col(f"d.{host}").eqNullSafe(F.col("s._host")) & F.col(f"d.{path}").eqNullSafe(F.col("s._path"))
    j = df.alias("d").join((F.broadcast(sites) if small else sites).alias("s"), same, "left")
    own, one = F.col(f"d.{p_col}"), F.lit(1)
    theta_h = (F.lit(k_host * m) + F.col("s._sh") - own) / (F.lit(k_host) + F.col("s._nh") - one)
    theta_p = (F.lit(k_path) * theta_h + F.col("s._sp") - own) / (F.lit(k_path) + F.col("s._np") - one)
    bound = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
    logit = lambda c: F.log(bound(c) / (1 - bound(c)))
    score: Column = logit(own) + logit(theta_p) - F.lit(math.log(m / (1 - m)))
    return j.select("d.*", bound(theta_h).alias(free[0]), bound(theta_p).alias(free[1]), (1 / (1 + F.exp(-score))).alias(free[2]))


def op6_site_shrunk_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's classifier probability, the posteriors of its host (source) and path (source, language), and whether it stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = written(model.probability(docs, keep_text=False))
    out = with_posteriors(scored, scored, "quality", "source", "lang")
    return out.select("doc_id", held_out().alias("held_out"), F.col("quality").alias("doc_score"), "host_posterior", "path_posterior", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
