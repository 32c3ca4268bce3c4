"""Connected components by alternating large and small stars over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.storage import dropped, gathered, written


def _min_neighbour(arcs: DataFrame) -> DataFrame:
    """u, m: the least of u and its neighbours."""
    return arcs.groupBy("u").agg(F.min("w").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """v, c: every vertex of ``links`` (a, b: long) with the least vertex that it is linked to, through others or itself.

    The result is a written table. Groups of any size are joined on single keys, never gathered.
    """
    links = gathered(links)
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    loops = written(links.select(F.explode(F.array("a", "b")).alias("v")).distinct())
    before = None
    while True:
        edges = gathered(edges)
        # large star: neighbours above u go to the least around u
        both = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("w")), F.struct(F.col("b").alias("u"), F.col("a").alias("w")))
        arcs = edges.select(F.explode(both).alias("e")).select("e.*")
        least = _min_neighbour(arcs)
        large = arcs.join(least, "u").where("w > u").select(F.col("m").alias("a"), F.col("w").alias("b")).where("a <> b").distinct()
        large = gathered(written(large))
        # small star: neighbours below u, and u, go to the least of them
        least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.join(least, F.col("b") == F.col("u")).select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = written(small)
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        dropped(edges, large)
        edges = new
        if now == before or now[0] == 0:
            break
        before = now
    # now each edge leads from a component's least vertex to another of it
    out = written(gathered(loops).join(gathered(edges), F.col("v") == F.col("b"), "left").select("v", F.coalesce("a", "v").alias("c")))
    dropped(edges, loops)
    return out
