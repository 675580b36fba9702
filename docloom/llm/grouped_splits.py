"""Problem 2: splits that keep related records together.

Distributed union-find: every partition links its own edges into a local forest, and forests are merged level by level.
Only nodes that several forests hold go up a level (as an edge between their roots), so each level sees a contracted
graph; a graph too large for the next merge is first contracted by star joins. Groups then go, largest first, to the
split furthest below its target.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.runtime import cut_lineage, table

TARGETS = {"train": 70, "validation": 15, "test": 15}

#: Edges that one task merges at most; a larger contracted graph takes a round of star joins first.
TASK_EDGES = 2_000_000

#: Edges of one part of the lowest level, about; its parts at least; and parts that one of the next level merges.
PART_EDGES, LEAST_PARTS, FAN_IN = 500_000, 16, 4

#: Groups of one size that one task ranks, about.
BUCKET_GROUPS = 100_000


def clean_id(column: F.Column | str) -> F.Column:
    """An id in upper case with single underscores as separators; null, blank and '?' are no id."""
    trimmed = F.regexp_replace(column, r"(?U)^\s+|\s+$", "")
    plain = F.upper(F.regexp_replace(trimmed, r"(?U)[\s\-_]+", "_"))
    return F.when(~plain.isin("", "?", "_"), plain)


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of one partition -> (node, root); the root is the smallest node of its tree."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([root(x) for x in part], pa.string())], ["node", "root"])


def components(edges: DataFrame, *, task_edges: int = TASK_EDGES, part_edges: int = PART_EDGES, least_parts: int = LEAST_PARTS, fan_in: int = FAN_IN) -> DataFrame:
    """(node, root) of an undirected graph given as (u, v) strings, u = v for a lone node; the root is the smallest node.

    Order is that of bytes. Edges with a null are ignored; repeated edges do no harm; no edges give no rows.

    Level 0: the edges, by a hash of both ends so that a node of many edges is no single part's, in parts of about
    part_edges, a forest each. A node that several forests hold becomes an edge between its roots; from level to level fan_in
    parts are merged into one, whose forest has an edge less for each that closed a circle, up to one part. Where even the
    contracted graph exceeds task_edges, star joins shrink it first.
    """
    edges = cut_lineage(edges.where("u is not null and v is not null").select("u", "v"))
    parts, by = max(least_parts, -(-edges.count() // part_edges)), F.xxhash64("u", "v")
    forest = cut_lineage(edges.repartition(parts, by).mapInArrow(_local_forest, "node string, root string"))
    roots = forest.groupBy("node").agg(F.min("root").alias("m"))
    above = cut_lineage(forest.join(roots, "node").where("root <> m").select(F.col("root").alias("u"), F.col("m").alias("v")).distinct())
    n = above.count()
    if n == 0:
        return roots.select("node", F.col("m").alias("root"))
    while n > task_edges:  # alternate large and small stars until the contracted graph fits one merge
        stars = cut_lineage(_star(_star(above, large=True), large=False))
        if stars.count() == n and stars.exceptAll(above).isEmpty():
            break
        above, n = stars, stars.count()
    if n <= task_edges:
        upper = above
        while parts > 1:
            parts = -(-parts // fan_in)
            upper = upper.repartition(parts, by).mapInArrow(_local_forest, "u string, v string").where("u <> v")
        top = upper.mapInArrow(_local_forest, "node string, root string")
    else:
        top = above.select(F.col("u").alias("node"), F.col("v").alias("root"))
    top = cut_lineage(top)
    named = roots.join(top.withColumnsRenamed({"node": "m", "root": "top"}), "m", "left")
    return named.select("node", F.coalesce("top", "m").alias("root"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on (u, v): every node links its larger (large) or smaller neighbours and itself to the smallest."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(low, "u")
    if large:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return linked.select("v", "m").unionByName(low.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def record_groups(records: DataFrame, *, id_col: str = "record_no", keys: tuple[str, ...] = ("regime_a.regime_id", "regime_b.regime_id")) -> DataFrame:
    """(id_col, group_id): the smallest key of the group of records that share keys, directly or through others.

    A record without any key joins nothing and has a null group_id. Repeated rows stay.
    """
    ids = records.select(F.col(id_col), *(clean_id(F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)))
    names = [f"_k{i}" for i in range(len(keys))]
    first = F.coalesce(*names)
    edges = ids.select(first.alias("u"), F.explode(F.array(*(F.coalesce(n, first) for n in names))).alias("v"))
    roots = components(edges.distinct()).select(F.col("node").alias("_first"), F.col("root").alias("group_id"))
    return ids.select(id_col, first.alias("_first")).join(roots, "_first", "left").select(id_col, "group_id")


def plan(histogram: dict[int, int], total: int, targets: dict[str, int] = TARGETS) -> dict[int, dict[str, int]]:
    """size -> how many groups of that size each split takes: largest first, each to the split furthest below target."""
    names = list(targets)
    lack = {s: total * targets[s] / sum(targets.values()) for s in names}
    out: dict[int, dict[str, int]] = {}
    for size in sorted(histogram, reverse=True):
        own, count = dict.fromkeys(names, 0), histogram[size]
        if count > 1000:  # in bulk: what the steps would give each split surely, down to a common level
            level = _level(list(lack.values()), size * (count - 3 * len(names)))
            for s in names:
                own[s] = max(0, int((lack[s] - level) // size))
                lack[s] -= own[s] * size
            count -= sum(own.values())
        heap = [(-lack[s], i) for i, s in enumerate(names)]
        heapq.heapify(heap)
        for _ in range(count):
            short, i = heap[0]
            own[names[i]] += 1
            heapq.heapreplace(heap, (short + size, i))
        lack = {names[i]: -x for x, i in heap}
        out[size] = own
    return out


def _level(lack: list[float], volume: float) -> float:
    """The level down to which `volume` fills the lacks."""
    highest = sorted(lack, reverse=True)
    for k in range(1, len(highest) + 1):
        level = (sum(highest[:k]) - volume) / k
        if k == len(highest) or level >= highest[k]:
            return level
    return 0.0


def assign_splits(records: DataFrame, *, id_col: str = "record_no", keys: tuple[str, ...] = ("regime_a.regime_id", "regime_b.regime_id"), targets: dict[str, int] = TARGETS, bucket_groups: int = BUCKET_GROUPS) -> DataFrame:
    """(id_col, group_id, split): a group lies in one split; a record without key is a group of its own.

    The driver sees only how many groups of each size there are (at most the root of twice the records). Groups of one
    size are ranked by a count per hash bucket and a place in the bucket; there are as many buckets as it takes for about
    bucket_groups groups in each, so no task holds all of them.
    """
    grouped = record_groups(records, id_col=id_col, keys=keys).withColumn("_g", F.coalesce(F.concat(F.lit("g"), "group_id"), F.concat(F.lit("r"), F.col(id_col).cast("string"))))
    groups = cut_lineage(grouped.groupBy("_g").agg(F.count(F.lit(1)).alias("size")))
    groups = groups.withColumn("bucket", F.pmod(F.xxhash64("_g"), F.lit(max(1, -(-groups.count() // bucket_groups)))))
    counts = groups.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    spark = records.sparkSession
    wanted = [(size, s, n) for size, own in plan(histogram, sum(k * n for k, n in histogram.items()), targets).items() for s, n in own.items()]
    starts, at = [], {}
    for size, s, n in wanted:
        starts.append((size, s, at.get(size, 0), at.get(size, 0) + n))
        at[size] = at.get(size, 0) + n
    ranges = spark.createDataFrame(starts, "size long, split string, low long, high long")
    from pyspark.sql import Window

    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("size", "bucket", F.coalesce("base", F.lit(0)).alias("base"))
    placed = groups.withColumn("place", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("_g")) - 1).join(before, ["size", "bucket"])
    ranked = placed.select("_g", "size", (F.col("base") + F.col("place")).alias("rank"))
    splits = ranked.join(ranges, (ranked["size"] == ranges["size"]) & (ranked["rank"] >= ranges["low"]) & (ranked["rank"] < ranges["high"])).select("_g", "split")
    return grouped.join(splits, "_g").select(id_col, "group_id", "split")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_groups(table(spark, sf_dir, "labelled_pairs"))


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_splits(table(spark, sf_dir, "labelled_pairs"))


def _sql_id(x: str) -> str:
    plain = rf"upper(regexp_replace(trim({x}), '[\s\-_]+', '_', 'g'))"
    return f"CASE WHEN {plain} NOT IN ('', '?', '_') THEN {plain} END"


SQL = {
    "p2_found": f"""WITH RECURSIVE ids AS (SELECT record_no, {_sql_id('regime_a.regime_id')} AS a, {_sql_id('regime_b.regime_id')} AS b FROM labelled_pairs),
keyed AS (SELECT record_no, coalesce(a, b) AS u, coalesce(b, a) AS v FROM ids),
links AS (SELECT u, v FROM keyed WHERE u IS NOT NULL UNION SELECT v, u FROM keyed WHERE u IS NOT NULL),
reach(node, other) AS (SELECT u, u FROM links UNION SELECT r.node, l.v FROM reach r JOIN links l ON r.other = l.u),
tops AS (SELECT node, min(other) AS group_id FROM reach GROUP BY node)
SELECT record_no, group_id FROM keyed LEFT JOIN tops ON u = node"""
}
