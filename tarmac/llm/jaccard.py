"""Exact Jaccard join of shingle sets by pivots, Voronoi regions and triangle-inequality windows.

Jaccard distance is a metric, but documents that share nothing are all at distance 1 from each other and
from any pivot, so pivots drawn from the whole table would tell them apart by nothing. The first
regions are therefore seeded by rare shingles: two linked sets share some of the least shingles of both
in any fixed order of all shingles (rare ones first), so a region for each such shingle, with the sets
replicated that hold it, loses no link. From there on documents are pivots, level by level:

1. each region's most central set is its first pivot, and all its other sets measure their distance to
   it: exactly, unless a bound shows that they are out of reach. Sets within the radius of 0.2 fall to
   the pivot's component. Sets of one component need no more tests among each other, so a region of one
   component is finished. A pivot that has met its region leaves it;
2. a region that is still large at the third level draws several pivots. Each set goes to the cell of its nearest pivot, or to
   the rest if all are beyond ``CUT``. A set of another cell is replicated to a cell if the triangle
   inequality lets it be linked to one of the cell's sets: if its distance to the pivot is at most the cell's
   radius and 0.2 (one way for two cells, as a pair has to meet once). Cells and rests are the
   regions of the next level, and within them only pairs are met whose distances to the pivot lie within 0.2
   of each other. A region that replication would make larger than ``GROWTH`` times itself stays whole,
   without its pivots;
3. a small region is joined in one task: it compares the sketches of its sets, by size and window, and passes
   on only the pairs that these do not hold apart, for the exact test.

So every linked pair is either tested or already joined through others. Where a region's sets are unlinked and
all near each other, cells do not divide it, and its pairs are met one pivot after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.batches import mapped, slices
from tarmac.llm.components import components
from tarmac.llm.shingles import differences_within, fingerprint, least_difference, odd_sketch, shingle_sets
from tarmac.llm.storage import dropped, free_name, gathered, written

#: Shingles that count as common (in more sets than this), at most; the order alone depends on them, not the result.
COMMON_SETS, COMMON = 64, 1 << 17
#: Distance of linked sets, at most (with room for rounding).
RADIUS = 0.2 + 1e-6
#: Hashes counted together by a task, and ids that may be broadcast (16 bytes each); more are joined by shuffle.
COUNTED, BROADCAST_IDS = 2_000_000, 500_000
#: Prefix shingles that a task sorts at a time before the shuffle; and after it, on average.
PACKED, BUCKET = 1_000_000, 250_000


def least_overlap(n: int) -> int:
    """Shingles that a set of n shares with any linked one: 4 n / 5 or more."""
    return (4 * n + 4) // 5


def shared_prefix(n: int) -> int:
    """Prefix shingles that a set of n asks a partner to share."""
    return max(1, n // 20)


def prefix_length(n: int) -> int:
    return n - least_overlap(n) + shared_prefix(n)


def common_shingles(docs: DataFrame, text_col: str) -> list[int]:
    """Hashes of the most common shingles, least first. Tasks count all their distinct texts and pass on what repeats."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held, n, seen = [], 0, set()

        def counted():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            more = counts > 1
            held.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(values[more].view(np.int64)), pa.array(counts[more].astype(np.int64))], ["s", "n"])

        for b in slices(batches):
            texts = {h: text for text in b.column(0).cast(pa.binary()).to_pylist() if text and (h := hash(text)) not in seen}
            seen.update(texts)
            for s in shingle_sets(list(texts.values())):
                held.append(s)
                n += len(s)
                if n > COUNTED:
                    n = 0
                    yield counted()
        if held:
            yield counted()

    counts = mapped(docs.select(text_col), run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") > COMMON_SETS).orderBy(F.desc("n"), "s").limit(COMMON).select("s").collect()
    return sorted(r[0] & 0xFFFFFFFFFFFFFFFF for r in rows)


def shingled(docs: DataFrame, id_col: str, text_col: str, common: list[int], hashed: bool = False) -> DataFrame:
    """doc_id, key (the id, or else a hash of the text), n (set size), v and w (the halves of the set's name), sketch, prefix and common (how many of the prefix are; null where the task has had the set); t, a hash of the text, if ``hashed``."""
    import numpy as np

    last = np.array(common, dtype=np.uint64)
    more = ["t"] if hashed else []

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        had: set[tuple] = set()
        for b in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for s in shingle_sets(b.column(2).cast(pa.binary()).to_pylist()):
                n, name = len(s), fingerprint(s)
                new = n > 0 and name not in had
                sketch = prefix = known = None
                if new:
                    if len(had) < 200_000:
                        had.add(name)
                    k, known = prefix_length(n), 0
                    if len(last):
                        at = np.searchsorted(last, s)
                        rare = last[np.minimum(at, len(last) - 1)] != s
                        s_first = s[rare][:k]
                        known = k - len(s_first)
                        order = np.concatenate([s_first, s[~rare][:known]]) if known else s_first
                    else:
                        order = s[:k]
                    sketch, prefix = odd_sketch(s), order.tobytes()
                for column, value in zip(out, (n, *name, sketch, prefix, known), strict=True):
                    column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True)), *b.columns[3:]], ["doc_id", "key", "n", "v", "w", "sketch", "prefix", "common", *more])

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), _key(id_col, text_col).alias("key"), F.col(text_col).alias("text"), *(F.xxhash64(text_col).alias(c) for c in more))
    return mapped(keyed, run, "doc_id long, key long, n int, v long, w long, sketch binary, prefix binary, common int" + "".join(f", {c} long" for c in more))


def _key(id_col: str, text_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col))


def _named_apart(sets: DataFrame) -> DataFrame:
    """``sets`` with another v where two different sets have one: written again for as long as there are any."""
    while True:
        pairs = sets.where("n > 0").select("v", "w").distinct()
        clash = written(pairs.groupBy("v").count().where("count > 1").select("v"))
        if clash.isEmpty():
            dropped(clash)
            return sets
        at = clash.select(F.col("v").alias("_v"))
        apart = written(sets.join(at, F.col("v") == F.col("_v"), "left").withColumn("v", F.when(F.col("_v").isNull(), F.col("v")).otherwise(F.xxhash64("v", "w"))).drop("_v"))
        dropped(sets, clash)
        sets = apart


def _packed(sets: DataFrame, buckets: int) -> DataFrame:
    """bucket, s, v, n: the prefix shingles of the sets that are not known to be common, as bytes of many numbers each; s decides the bucket."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held, n = [], 0

        def out():
            s, v, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            # the first shingles of a set are its least, so only the rest of a division is spread evenly
            bucket = (s.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            s, v, n = s[order], v[order], n[order]
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
            some = [(i, slice(lo, hi)) for i, (lo, hi) in enumerate(zip(edges, edges[1:])) if lo < hi]
            for at in range(0, len(some), 64):
                part = some[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int32()), *(pa.array([x[k].tobytes() for _, k in part], pa.binary()) for x in (s, v, n))], ["bucket", "s", "v", "n"])

        for b in slices(batches, 2000):
            v, size, common = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            rare = [np.frombuffer(p, np.int64)[: len(p) // 8 - c] for p, c in zip(b.column(3).to_pylist(), common.tolist(), strict=True)]
            many = [len(x) for x in rare]
            held.append((np.concatenate([np.zeros(0, np.int64), *rare]), np.repeat(v, many), np.repeat(size, many)))
            n += sum(many)
            if n > PACKED:
                yield from out()
                n = 0
        if n:
            yield from out()

    return mapped(sets.select("v", "n", "common", "prefix"), run, "bucket int, s binary, v binary, n binary")


def _common_rows(sets: DataFrame) -> DataFrame:
    """s, v, n: a row for each prefix shingle of each set that is known to be common."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in slices(batches, 2000):
            many = b.column(2).to_numpy(zero_copy_only=False)
            last = [np.frombuffer(p, np.int64)[len(p) // 8 - c :] for p, c in zip(b.column(3).to_pylist(), many.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *last])), *(pa.array(np.repeat(b.column(i).to_numpy(zero_copy_only=False), many)) for i in (0, 1))], ["s", "v", "n"])

    return mapped(sets.where("common > 0").select("v", "n", "common", "prefix"), run, "s long, v long, n int")


def _seeded(sets: DataFrame) -> DataFrame:
    """s, v, n: the rows of the regions with two different sets.

    A common shingle is in many sets, so no task needs to look at its rows together; what others share is few.
    Most shingles are in one set, so they go through the shuffle by buckets, many in a row, and are sorted in a task's arrays.
    """
    sets = sets.where(F.col("prefix").isNotNull())
    rare = sets.agg(F.sum(F.length("prefix") / 8 - F.col("common"))).first()[0] or 0
    buckets = max(1, -(-int(rare) // BUCKET))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def take(held):
            s, v, n = (np.concatenate([np.frombuffer(x, t) for x in column]) for column, t in zip(zip(*held, strict=True), (np.int64, np.int64, np.int32), strict=True))
            order = np.lexsort((v, s))
            s, v, n = s[order], v[order], n[order]
            more = s[1:] == s[:-1]
            once = np.concatenate([[True], ~more | (v[1:] != v[:-1])])
            s, v, n = s[once], v[once], n[once]
            more = np.concatenate([[False], s[1:] == s[:-1], [False]])
            two = more[1:] | more[:-1]
            return pa.RecordBatch.from_arrays([pa.array(x[two]) for x in (s, v, n)], ["s", "v", "n"])

        at, held = None, []
        for b in batches:
            for i, *x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if i != at and held:
                    yield take(held)
                    held = []
                at = i
                held.append(x)
        if held:
            yield take(held)

    few = mapped(_packed(sets, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket"), run, "s long, v long, n int")
    return few.unionByName(_common_rows(sets).dropDuplicates(["s", "v"]))


def _shared(rows: DataFrame) -> DataFrame:
    """Rows of regions with two different sets, by sums that are made before the shuffle."""
    two = rows.groupBy("s").agg(F.min("v").alias("_a"), F.max("v").alias("_b")).where("_a <> _b").select("s")
    return rows.join(two, "s", "left_semi")


def joined_by_ids(df: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """``df`` joined to a written table of ids, which is broadcast if it is small."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, how)


def _sets(docs: DataFrame, id_col: str, text_col: str, active: DataFrame) -> DataFrame:
    """v, items: the whole sets named in ``active`` (key, v, w), from their texts. Rows that repeat a key and text may repeat a set, once per task."""
    known = active.select(F.col("key").alias("_key"), F.col("v").alias("_v"), F.col("w").alias("_w"))
    texts = docs.select(_key(id_col, text_col).alias("_key"), F.col(text_col).alias("text"))
    texts = joined_by_ids(texts, known, "_key", "inner").select("_v", "_w", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        had: set[int] = set()
        for b in slices(batches):
            names, items = [], []
            v, w = (b.column(i).to_pylist() for i in range(2))
            new = [i for i in range(b.num_rows) if v[i] not in had]
            texts = b.column(2).take(pa.array(new, pa.int64())).cast(pa.binary()).to_pylist()
            for v, w, s in zip([v[i] for i in new], [w[i] for i in new], shingle_sets(texts), strict=True):
                if v not in had and fingerprint(s)[1] == w:  # a key may have several texts
                    had.add(v)
                    names.append(v)
                    items.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(items, pa.binary())], ["v", "items"])

    return mapped(texts, run, "v long, items binary")


def _near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """v, p, lo, near: the least distance that sizes and sketches allow, and whether that is within the radius."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches):
            v, p, n, m, x, y = (c.to_pylist() for c in b.columns)
            apart = [least_difference(x[i], y[i]) for i in range(b.num_rows)]
            # of sets that differ in at least d of n + m: intersection (n + m - d) / 2, union (n + m + d) / 2
            lo = [max(2 * d / (i + j + d), 1 - min(i, j) / max(i, j)) for d, i, j in zip(apart, n, m, strict=True)]
            near = [9 * d <= i + j and 5 * min(i, j) >= 4 * max(i, j) for d, i, j in zip(apart, n, m, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lo, pa.float64()), pa.array(near, pa.bool_())], ["v", "p", "lo", "near"])

    both = pairs.join(sketches, "v").join(sketches.select(F.col("v").alias("p"), F.col("sketch").alias("_sketch")), "p")
    return mapped(both.select("v", "p", "n", "m", "sketch", "_sketch"), run, "v long, p long, lo double, near boolean")


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """v, p, d (the exact distance) and linked, as a written table."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in slices(batches):
            far, linked = [], []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                far.append(1 - both / union)
                linked.append(100 * both >= 80 * union)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(far, pa.float64()), pa.array(linked, pa.bool_())], ["v", "p", "d", "linked"])

    # only sets that a pair names are shuffled
    named = written(pairs.select(F.explode(F.array("v", "p")).alias("v")).distinct())
    sets = joined_by_ids(sets, named, "v", "left_semi")
    both = pairs.join(sets, "v").join(sets.select(F.col("v").alias("p"), F.col("items").alias("_items")), "p")
    out = written(mapped(both.select("v", "p", "items", "_items"), run, "v long, p long, d double, linked boolean").dropDuplicates(["v", "p"]))
    dropped(named)
    return out


#: Pivots of a region at each level.
PIVOTS = (1, 8, 16, 64, 256, 1024)
#: The level from which regions are divided into cells or left to a task; before it, most have become one component.
DIVIDED = 2
#: The farthest that a set's nearest pivot may be, and the rows of a divided region's cells against its own, at most.
CUT, GROWTH = 0.6, 2.0
#: A region is left to one task if it has at most so many rows, and pairs of a row
#: outside its largest component with any row. A task compares sketches as rows of a matrix, where pivots join and
#: shuffle each pair; so a region must be large before its pivots cost less than its pairs.
LEAF_ROWS, LEAF_PAIRS = 20_000, 1 << 23

#: Pairs that a leaf's task holds before it passes them on.
FOUND = 100_000


def _close_in_leaves(rows: DataFrame) -> DataFrame:
    """v, p: of small regions (s, v, n, c, lo, hi, sketch), the pairs that may be linked and are of two components."""

    def close(part):
        import numpy as np

        v, n, c, lo, hi = (part.column(x).to_numpy() for x in ("v", "n", "c", "lo", "hi"))
        n = n.astype(np.int64)
        names, counts = np.unique(c, return_counts=True)
        minor = np.flatnonzero(c != names[counts.argmax()])
        for i, j, apart in differences_within(part.column("sketch").to_pylist(), n, minor):
            ok = (9 * apart <= n[i] + n[j]) & (c[j] != c[i]) & (lo[j] - hi[i] <= RADIUS) & (lo[i] - hi[j] <= RADIUS)
            for k in j[ok]:
                yield v[i], v[k]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: list = []
        found: set = set()

        def out():
            pairs = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["v", "p"])

        def take(table) -> Iterator:
            s = table.column("s").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)]])
            for lo, hi in zip(edges, edges[1:]):
                for x, y in close(table.slice(lo, hi - lo)):
                    found.add((int(min(x, y)), int(max(x, y))))
                    if len(found) > FOUND:
                        yield out()

        for b in batches:
            if not b.num_rows:
                continue
            # the last region may go on in the next batch
            s = b.column(0).to_numpy()
            last = int(np.searchsorted(s, s[-1]))
            if last:
                yield from take(pa.Table.from_batches([*held, b.slice(0, last)]).combine_chunks())
                held = []
            held.append(b.slice(last))
        if held:
            yield from take(pa.Table.from_batches(held).combine_chunks())
        yield out()

    kept = rows.select("s", "v", "n", "c", "lo", "hi", "sketch").repartition("s").sortWithinPartitions("s")
    return mapped(kept, run, "v long, p long").distinct()


def _with_regions(rows: DataFrame) -> DataFrame:
    """``rows`` (s, v, n, g, lo, hi, c) of the regions of several components, with their size m, their largest component's size k and most central set head."""
    central = F.max(F.struct("g", F.xxhash64("v").alias("h"), F.col("v").alias("head")))
    of = rows.groupBy("s", "c").agg(F.count("*").alias("k"), central.alias("x"))
    of = of.groupBy("s").agg(F.sum("k").alias("m"), F.max("k").alias("k"), F.count("*").alias("_parts"), F.max("x").alias("x")).where("_parts > 1")
    return rows.join(of.select("s", "m", "k", F.col("x.head").alias("head")), "s")


def _cells(rows: DataFrame, met: DataFrame) -> DataFrame:
    """s, v, n, g, lo, hi: the next regions of ``rows`` (s, v, n, g, lo, hi, m: no pivots), divided by ``met``.

    ``met`` has s, v, p and near (the lower bound of the distance), and d, exact where near is within ``CUT``.
    """
    own = met.where(F.col("d") <= CUT).groupBy("s", "v").agg(F.min(F.struct("d", "p")).alias("x")).select("s", "v", F.col("x.p").alias("_own"), F.col("x.d").alias("_d"))
    radius = own.groupBy("s", F.col("_own").alias("p")).agg(F.max("_d").alias("_radius"))
    # of a linked pair of two cells, the set of the higher pivot is replicated to the lower one
    reach = (F.coalesce("d", "near") <= F.col("_radius") + RADIUS) & (F.col("_own").isNull() | (F.col("p") <= F.col("_own")))
    within = met.join(radius, ["s", "p"]).join(own, ["s", "v"], "left").where(reach)
    cells = within.select("s", "v", "p", F.coalesce(F.col("d") - 1e-9, "near").alias("lo"), F.coalesce(F.col("d") + 1e-9, F.lit(1.0)).alias("hi"))
    rest = rows.select("s", "v", "lo", "hi").join(own, ["s", "v"], "left_anti").withColumn("p", F.lit(None).cast("long"))
    every = cells.unionByName(rest)
    divided = every.groupBy("s").agg(F.count("*").alias("_rows"))
    plain = rows.select("s", "v", "n", "g", "m", F.col("lo").alias("_lo"), F.col("hi").alias("_hi")).join(divided, "s", "left")
    grown = F.coalesce("_rows", F.lit(0)) > F.col("m") * GROWTH
    kept = plain.where(grown).select("s", "v", "n", "g", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))
    parts = plain.where(~grown).select("s", "v", "n", "g").join(every, ["s", "v"])
    return kept.unionByName(parts.select(F.xxhash64("s", F.coalesce("p", F.lit(0).cast("long")), F.col("p").isNull()).alias("s"), "v", "n", "g", "lo", "hi"))


def _links(regions: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame | None:
    """v, c: a component for each set of the regions (s, v, n) that has a link; None if there are no links."""
    # central sets, in many and large regions, make the first pivots
    sizes = regions.groupBy("s").agg(F.count("*").alias("_m"))
    central = regions.join(sizes, "s").groupBy("v").agg(F.sum("_m").alias("g"))
    live = written(regions.join(central, "v").withColumns({"lo": F.lit(0.0), "hi": F.lit(1.0)}))
    label, level = None, 0
    while True:
        live = gathered(live)
        rows = live if label is None else live.join(gathered(label), "v", "left")
        rows = rows.withColumn("c", F.col("v") if label is None else F.coalesce("c", "v"))
        rows = written(_with_regions(rows))
        if rows.isEmpty():
            dropped(rows, live)
            return label
        at = gathered(rows)
        window = (F.col("lo") - F.col("_hi") <= RADIUS) & (F.col("_lo") - F.col("hi") <= RADIUS)
        divided = at
        if level >= DIVIDED:
            leaf = (F.col("m") <= LEAF_ROWS) & (F.col("m") * (F.col("m") - F.col("k")) <= LEAF_PAIRS)
            leaves = written(_close_in_leaves(at.where(leaf).join(sketches, "v")))
            divided = at.where(~leaf)
        # the most central sets, which are pivots in all the regions that hold them; each task ranks its own before the shuffle
        ranked = divided.withColumn("_r", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("g"), F.desc(F.xxhash64("v")), F.desc("v"))))
        heads = ranked.where(F.col("_r") <= PIVOTS[min(level, len(PIVOTS) - 1)])
        heads = written(heads.select("s", F.col("v").alias("p"), F.col("n").alias("m_p"), F.col("c").alias("_c"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi")))
        met = divided.join(heads, "s").where(F.col("v") != F.col("p"))
        if level < DIVIDED:
            met = met.where((F.col("c") != F.col("_c")) & window)
        seen = written(_near(met.select("v", "p", "n", F.col("m_p").alias("m")).distinct(), sketches))
        near = gathered(seen).where("near" if level < DIVIDED else F.col("lo") <= CUT).select("v", "p")
        if level >= DIVIDED:
            near = near.unionByName(gathered(leaves)).distinct()
        measured = _distances(near, sets)
        exact = gathered(seen).select("v", "p", F.col("lo").alias("near")).join(gathered(measured).select("v", "p", "d"), ["v", "p"], "left")
        rest = divided.join(heads.select("s", F.col("p").alias("v")), ["s", "v"], "left_anti")
        if level == 0:
            # the distance to the region's first pivot, or what is known of it
            exact = exact.select("v", F.col("p").alias("head"), F.coalesce(F.col("d") - 1e-9, F.col("near") - 1e-9).alias("lo"), F.coalesce(F.col("d") + 1e-9, F.lit(1.0)).alias("hi"))
            rest = rest.where("m > 2").drop("lo", "hi").join(exact, ["v", "head"], "left").withColumns({"lo": F.coalesce("lo", F.lit(0.0)), "hi": F.coalesce("hi", F.lit(1.0))})
        if level < DIVIDED:
            new = written(rest.select("s", "v", "n", "g", "lo", "hi"))
        else:
            new = written(_cells(rest, rest.join(heads.select("s", "p"), "s").select("s", "v", "p").join(exact, ["v", "p"])))
            dropped(leaves)
        links = written(measured.where("linked").select(F.col("v").alias("a"), F.col("p").alias("b")))
        if not links.isEmpty():
            label = _relabelled(label, links)
        dropped(live, rows, heads, seen, measured, links)
        live, level = new, level + 1


def _relabelled(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """The labels (v, c) after more links: components of the components that they join."""
    if label is None:
        return components(links)
    old, links = gathered(label), gathered(links)
    named = links.join(old.select(F.col("v").alias("a"), F.col("c").alias("_ca")), "a", "left").join(old.select(F.col("v").alias("b"), F.col("c").alias("_cb")), "b", "left")
    joined = written(named.select(F.coalesce("_ca", "a").alias("a"), F.coalesce("_cb", "b").alias("b")))
    roots = components(joined)
    at = gathered(roots)
    merged = old.join(at.select(F.col("v").alias("c"), F.col("c").alias("_c")), "c", "left").select("v", F.coalesce("_c", "c").alias("c"))
    new = written(merged.unionByName(at.join(old, "v", "left_anti")))
    dropped(label, joined, roots)
    return new


def _labelled(docs: DataFrame, id_col: str, text_col: str, hashed: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ``shingled``, and v, c: a component for each linked set (None if there are no links)."""
    docs = docs.select(F.col(id_col), F.col(text_col))
    sets = _named_apart(written(shingled(docs, id_col, text_col, common_shingles(docs, text_col), hashed)))
    regions = written(_seeded(sets))
    # a set with a link shares at least so many of its prefix shingles with others
    enough = F.greatest(F.lit(1), F.floor(F.floor((4 * F.col("n") + 4) / 5) / 20))
    active = regions.groupBy("v", "n").count().where(F.col("count") >= enough).select("v")
    some = written(regions.join(active, "v"))
    few = written(_shared(some))
    dropped(regions, some)
    known = written(sets.where(F.col("prefix").isNotNull()).join(few.select("v").distinct(), "v").groupBy("v").agg(F.min(F.struct(F.col("doc_id").isNull(), "key", "w", "sketch")).alias("x")).select("v", "x.key", "x.w", "x.sketch"))
    items = written(_sets(docs, id_col, text_col, known))
    label = _links(few, known.select("v", "sketch"), items)
    dropped(items, few, known)
    return sets, label


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``; the least doc_id of what links lead to.

    Sets with 100 * intersection >= 80 * union are linked, equal sets included. A null, empty or blank
    text has an empty set and is linked to nothing. Rows with a null id take part in links, but are never a
    component's name; alone, their component is null. Rows may repeat. Ids are
    whole numbers, or text of them: an id that is no number is an error, as the least id names a component. Other columns are ignored.
    """
    sets, label = _labelled(docs, id_col, text_col)
    # the least id of equal sets, and then of linked ones
    own = sets.where("n > 0").groupBy("v").agg(F.min("doc_id").alias("_least"))
    own = written(own)
    if label is not None:
        named = own.join(label, "v", "left").withColumn("c", F.coalesce("c", "v"))
        least = named.groupBy("c").agg(F.min("_least").alias("_of"))
        linked = written(named.join(least, "c").select("v", F.col("_of").alias("_least")))
        dropped(own, label)
        own = linked
    out = sets.select("doc_id", "n", "v").join(own, "v", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col("doc_id")).alias("component_id"))


def op8_pivot_jaccard_components(spark, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and component of near copies."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def one_row_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: the one of the least id (null last), then set, then text, then other columns.

    Rows are told apart by id and text, so rows of different components stay though their ids are equal or
    null. A null, empty or blank text is linked to nothing: of these one row of each id stays, and all of null id.
    """
    sets, label = _labelled(docs, id_col, text_col, hashed=True)
    own = written(sets.groupBy("doc_id", "t", "v", "n").count())
    dropped(sets)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "v", "t")
    least = own.where("n > 0").groupBy("v").agg(F.min(order).alias("x"))
    if label is not None:
        least = least.join(label, "v", "left").groupBy(F.coalesce("c", "v").alias("c")).agg(F.min("x").alias("x"))
    blank = own.where("n = 0 and doc_id is not null").groupBy("doc_id").agg(F.min("t").alias("t"))
    stay = written(least.select("x.doc_id", "x.t").unionByName(blank))
    dropped(*([label] if label is not None else []))
    dealt = own.where("n > 0 or doc_id is not null")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))
    stays = stay.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"))
    gone = written(dealt.join(stays, same, "left_anti").select("doc_id", "t"))
    repeated = written(dealt.where("count > 1").join(stays, same, "left_semi").select("doc_id", "t"))
    dropped(own, stay)
    names: list[str] = []
    for x in ("_id", "_t", "_of_id", "_of_t"):
        names.append(free_name([*docs.columns, *names], x))
    doc, text, of_doc, of_text = names
    rows = docs.withColumns({doc: F.col(id_col).cast("long"), text: F.xxhash64(text_col)})

    def joined(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        ids = ids.select(F.col("doc_id").alias(of_doc), F.col("t").alias(of_text))
        return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, F.col(doc).eqNullSafe(F.col(of_doc)) & (F.col(text) == F.col(of_text)), how)

    kept = joined(rows, gone, "left_anti")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    whole, others = F.struct(*docs.columns), F.struct(*(c for c in docs.columns if c != text_col))
    once = joined(kept, repeated, "left_semi").groupBy(doc, text).agg(F.min_by(whole, F.to_json(others)).alias("x"))
    return joined(kept, repeated, "left_anti").select(*docs.columns).unionByName(once.select("x.*"))
