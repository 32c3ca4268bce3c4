"""How document filters interact: what each order of them removes, from one SQL CUBE over their failure flags.

Documents become counts of (part, flags) cells, and the CUBE is taken over the cells, so that its 64 grouping
sets multiply cells and not documents. A grouping set names a subset of filters; its row in which all selected
flags are false counts the documents that survive that subset. A step of an order is the pair of the subsets
before and after it, so every figure of a step is a difference of survivors.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.storage import dropped, written

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
_SPACE = "[\\x20\\x09-\\x0D]+"
_MEASURES = ("docs", "good", "toxic")


def failures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """_id, _part, _text (a digest) and the failure flags A to D of every row of ``docs``, over whole texts.

    A null text is empty and a null part the empty string; an empty text has no words, so A fails and B does
    not. Other columns are left behind, whatever their names.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("_part"), t.alias("_t"))
    rows = rows.withColumn("_words", F.array_remove(F.split("_t", _SPACE), ""))
    words = rows.withColumn("_n", F.size("_words")).withColumn("_distinct", F.size(F.array_distinct("_words")))
    capitals = F.length("_t") - F.length(F.regexp_replace("_t", "[A-Z]+", ""))
    return words.select(
        "_id", "_part", F.unhex(F.sha2("_t", 256)).alias("_text"),
        (F.col("_n") < 200).alias("A"),
        (100 * F.col("_distinct").cast("long") < 50 * F.col("_n").cast("long")).alias("B"),
        (100 * capitals.cast("long") > 2 * F.length("_t").cast("long")).alias("C"),
        F.col("_t").rlike("[#$%&*|]").alias("D"),
    )


def flagged(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``failures`` with flag E (a smaller id has the same text) and whether labels call the row good or toxic.

    The least id of each text is found by a grouped minimum and joined back by (id, text), so that no task gets
    all copies of a text. Rows that repeat the least id pass, as no smaller id has their text; so does a row
    without an id, which is no other's smaller copy either. Of several labels of an id any 1 counts.
    """
    first = rows.where(F.col("_id").isNotNull()).groupBy("_text").agg(F.min("_id").alias("_id")).withColumn("_first", F.lit(True))
    known = labels.select(F.col("doc_id").alias("_id"), (F.col("quality") == 1).alias("_g"), (F.col("toxic") == 1).alias("_x"))
    known = known.where("_id IS NOT NULL AND (_g OR _x)").groupBy("_id").agg(F.max("_g").alias("_good"), F.max("_x").alias("_toxic"))
    # null ids match nothing; the second key spreads them over all partitions
    spread = F.when(F.col("_id").isNull(), F.crc32("_text")).otherwise(F.lit(0))
    out = rows.withColumn("_s", spread).join(first, ["_id", "_text"], "left")
    out = out.join(known.withColumn("_s", F.lit(0).cast("long")), ["_id", "_s"], "left")
    e = F.col("_id").isNotNull() & F.col("_first").isNull()
    return out.select("_part", *FILTERS[:4], e.alias("E"), F.coalesce("_good", F.lit(False)).alias("_good"), F.coalesce("_toxic", F.lit(False)).alias("_toxic"))


def survivors(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part (null: all parts together), subset (a bit mask of filters), and docs, good and toxic that pass all of its filters.

    ``cells`` has part, a boolean column per filter and the three counts; subsets without survivors have no row.
    """
    flags = [F.col(f) for f in filters]
    cube = cells.cube("part", *flags).agg(*[F.sum(m).alias(m) for m in _MEASURES], *[F.grouping(c).alias(f"_{c}") for c in ("part", *filters)])
    selected = [F.col(f"_{f}") == 0 for f in filters]
    none_fails = F.lit(True)
    subset = F.lit(0)
    for i, f in enumerate(filters):
        none_fails = none_fails & (~selected[i] | ~F.col(f))
        subset = subset + F.when(selected[i], 1 << i).otherwise(0)
    # (a part is never null in cells, so a null part is the total)
    return cube.where(none_fails).select("part", subset.alias("subset"), *_MEASURES)


def steps(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """filter_order, step, filter, and the subsets before and after, for every order of ``filters``."""
    rows = []
    for order in permutations(filters):
        before = 0
        for i, f in enumerate(order):
            after = before | 1 << filters.index(f)
            rows.append(("".join(order), i + 1, f, before, after))
            before = after
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int, after int")


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order and step with what the step's filter removes and does not, by survivors of pairs of subsets.

    A part of ``cells`` has all rows, with zeros; null is all parts together. No cells give no rows.
    """
    spark, n = cells.sparkSession, len(filters)
    found = written(survivors(cells, filters))
    full = (1 << n) - 1
    # every part with each of the 2^n subsets (a list in the row, not a join), so that a subset without survivors counts 0
    parts = found.where("subset = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(full))).alias("subset"))
    same = parts["subset"].eqNullSafe(found["subset"]) & parts["part"].eqNullSafe(found["part"])
    counts = parts.join(found, same, "left").select(parts["part"], parts["subset"], *[F.coalesce(m, F.lit(0)).alias(m) for m in _MEASURES])

    before = counts.select("part", F.col("subset").alias("before"), *[F.col(m).alias(f"{m}_before") for m in _MEASURES])
    after = counts.select(F.col("part").alias("_part"), F.col("subset").alias("_after"), *[F.col(m).alias(f"{m}_after") for m in _MEASURES])
    single = F.create_map(*[x for i, f in enumerate(filters) for x in (F.lit(f), F.lit(1 << i))])
    # the pairs (subset, filter outside it): the 80 edges of the lattice carry all that a step shows
    edges = before.withColumn("filter", F.explode(F.array(*[F.lit(f) for f in filters])))
    edges = edges.where(F.col("before").bitwiseAND(single[F.col("filter")]) == 0).withColumn("after", F.col("before").bitwiseOR(single[F.col("filter")]))
    edges = edges.join(after, edges["part"].eqNullSafe(after["_part"]) & (edges["after"] == after["_after"]))
    size = F.bit_count("before")
    weight = F.element_at(F.array(*[F.lit(factorial(s) * factorial(n - 1 - s)) for s in range(n)]), (size + 1).cast("int"))
    gone = F.col("docs_before") - F.col("docs_after")
    edges = edges.select(
        "part", "filter", "before", "after", F.col("docs_after").alias("kept"), gone.alias("removed"), (gone * weight).alias("_weighed"),
        (F.col("good_before") - F.col("good_after")).alias("good_lost"), (F.col("toxic_before") - F.col("toxic_after")).alias("toxic_lost"),
    )
    own = edges.groupBy("part", "filter").agg(
        F.sum("_weighed").alias("shapley"),
        F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("_fails"),
        F.max(F.when(F.col("after") == full, F.col("removed"))).alias("unique_fails"),
    ).withColumnsRenamed({"part": "_part", "filter": "_filter"})
    edges = edges.join(own, edges["part"].eqNullSafe(own["_part"]) & (edges["filter"] == own["_filter"]))
    # orders have 600 rows, whatever the data
    out = edges.join(F.broadcast(steps(spark, filters)), ["before", "after", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("_fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from all documents in every order, by source.

    Empty tables give no rows. Repeated rows count each; texts of any length are read whole.
    """
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = written(failures(docs))  # some 60 bytes a document; read for the least ids and for the counts
    cells = flagged(rows, labels).groupBy(F.col("_part").alias("part"), *FILTERS).agg(F.count("*").alias("docs"), *[F.count_if(f"_{m}").alias(m) for m in _MEASURES[1:]])
    cells = written(cells)
    dropped(rows)
    return audit(cells).where("part IS NOT NULL")


_FAILS = {
    "A": "len(w) < 200",
    "B": "100 * len(list_distinct(w)) < 50 * len(w)",
    "C": "100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t)",
    "D": "regexp_matches(t, '[#$%&*|]')",
    "E": "coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)",
}
OP11_SQL = f"""WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM texts),
flags AS (SELECT doc_id, part, {" + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(_FAILS.values()))} AS mask FROM words),
known AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flags LEFT JOIN known USING (doc_id) GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES {", ".join(f"('{f}', {1 << i})" for i, f in enumerate(FILTERS))}) AS l(f, bit)),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = {ALL}),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, l.f, l.bit, coalesce((SELECT sum(o.bit) FROM letters o WHERE position(o.f IN filter_order) < step), 0) AS before
 FROM orders, range(1, 6) AS r(step), letters l WHERE position(l.f IN filter_order) = step),
counted AS (SELECT part, filter_order, step, f,
 sum(n) FILTER (mask & (before | bit) = 0) AS kept,
 sum(n) FILTER (mask & before = 0 AND mask & bit <> 0) AS removed,
 sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0) AS redundant,
 sum(n) FILTER (mask = bit) AS unique_fails,
 sum(good) FILTER (mask & before = 0 AND mask & bit <> 0) AS good_lost,
 sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0) AS toxic_lost
 FROM cells, (SELECT filter_order, step, f, CAST(bit AS INTEGER) AS bit, CAST(before AS INTEGER) AS before FROM steps) GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
 CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley FROM counted"""
