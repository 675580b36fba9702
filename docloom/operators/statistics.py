"""Agreement and resampling: Cohen's kappa, bootstrap intervals, paired tests.

A metric depends only on how many rows each cell (truth, prediction, types) holds, and there are few cells: 168 at most,
once types outside the vocabulary are told apart only as far as metrics do. A resample is therefore drawn against the
cells' shares: no row is joined. There is one way to draw at every size: a replicate's slots are hashed in blocks, which
are tasks' work of their own, and only the cells' counts leave a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import scores
from docloom.plans.runtime import cut_lineage
from docloom.schemas import CONFLICT_TYPES

#: Slots of a replicate that are drawn together; a multiple of four.
BLOCK_SLOTS = 1 << 20


def kappa_value(n: Column, agree: Column, chance: Column) -> Column:
    """(po - pe) / (1 - pe); NaN without rows or where chance agreement is complete."""
    po, pe = scores.ratio(agree, n), scores.ratio(chance, n * n)
    return F.when((n == 0) | (F.abs(1 - pe) < 1e-12), F.lit(float("nan"))).otherwise((po - pe) / (1 - pe))


def aligned_labels(first: DataFrame, second: DataFrame) -> DataFrame:
    """(pair_id, a, b, side): both annotators' labels outer-joined; side is both, only_1 or only_2."""
    a, b = first.select("pair_id", F.col("label").alias("a"), F.lit(1).alias("x")), second.select("pair_id", F.col("label").alias("b"), F.lit(1).alias("y"))
    side = F.when(F.col("x").isNull(), "only_2").when(F.col("y").isNull(), "only_1").otherwise("both")
    return a.join(b, "pair_id", "full_outer").select("pair_id", "a", "b", side.alias("side"))


def kappa_cells(pairs: DataFrame, by: list[str] = [], weight: str | None = None) -> DataFrame:
    """(by..., n, agree, chance): what kappa needs, over pairs with both labels in the vocabulary."""
    inside = pairs.where(F.col("a").isin(CONFLICT_TYPES) & F.col("b").isin(CONFLICT_TYPES))
    w = F.col(weight) if weight else F.lit(1)
    total = lambda c: F.sum(F.when(c, w).otherwise(0))
    chance = sum((total(F.col("a") == c) * total(F.col("b") == c) for c in CONFLICT_TYPES[1:]), total(F.col("a") == CONFLICT_TYPES[0]) * total(F.col("b") == CONFLICT_TYPES[0]))
    return inside.groupBy(*by).agg(F.coalesce(F.sum(w), F.lit(0)).alias("n"), F.coalesce(total(F.col("a") == F.col("b")), F.lit(0)).alias("agree"), F.coalesce(chance, F.lit(0)).alias("chance"))


def cohen_kappa(pairs: DataFrame, by: list[str] = []) -> DataFrame:
    """(by..., n, kappa, band)."""
    value = kappa_cells(pairs, by).select(*by, "n", kappa_value(F.col("n"), F.col("agree"), F.col("chance")).alias("kappa"))
    return value.select(*by, "n", F.round("kappa", 9).alias("kappa"), band(F.col("kappa")).alias("band"))


def band(kappa: Column) -> Column:
    """Landis and Koch's name for a kappa."""
    return F.when(kappa < 0, "poor").when(kappa < 0.21, "slight").when(kappa < 0.41, "fair").when(kappa < 0.6, "moderate").when(kappa < 0.81, "substantial").otherwise("almost perfect")


def kappa_confusion(pairs: DataFrame) -> DataFrame:
    """All 4 x 4 cells (a, b, n), zeros included."""
    names = [(x, y) for x in CONFLICT_TYPES for y in CONFLICT_TYPES]
    cells = F.array(*(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.count_if((F.col("a") == x) & (F.col("b") == y)).alias("n")) for x, y in names))
    return pairs.agg(cells.alias("c")).select(F.explode("c").alias("c")).select("c.*")


def plain_types(rows: DataFrame) -> DataFrame:
    """t_true and t_pred with few values: those outside the vocabulary only as equal ('?same') or unequal ('?other')."""
    known = lambda c: F.col(c).isNull() | F.col(c).isin(CONFLICT_TYPES)
    t_pred = F.when(known("t_pred"), F.col("t_pred")).when(F.col("t_pred") == F.col("t_true"), "?same").otherwise("?other")
    return rows.withColumns({"t_true": F.when(known("t_true"), F.col("t_true")).otherwise("?same"), "t_pred": t_pred})


def cell_counts(rows: DataFrame, cell: list[str]) -> DataFrame:
    """(cell..., n): the distinct cells with their sizes, as a table of its own; their combinations must be few."""
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in cell) + ", n long"
    return rows.sparkSession.createDataFrame(rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).collect(), schema)


def drawn(seed: int, b: int, first: int, last: int) -> np.ndarray:
    """What slots first..last - 1 of replicate b draw, out of 2^32: slot j has the j mod 4th word of md5(seed|b|j div 4)."""
    digests = b"".join(hashlib.md5(b"%d|%d|%d" % (seed, b, q)).digest() for q in range(first // 4, -(-last // 4)))
    return np.frombuffer(digests, ">u4")[first % 4 : first % 4 + last - first].astype(np.int64)


def thresholds(sizes: list[int]) -> np.ndarray:
    """The draw from which on each cell but the first begins: cells have their shares of 2^32, in their order."""
    ends = np.cumsum([0, *sizes], dtype=object)
    return np.array([-(-(int(e) << 32) // int(ends[-1])) for e in ends[1:-1]], np.int64)


def resample(rows: DataFrame, cell: list[str], *, order: list[str], replicates: int, seed: int = 42, block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """(b, cell..., w): how often replicate b drew a row of each cell; n draws with replacement per replicate.

    rows may also be the cell_counts already. cell columns must have few distinct values together (their combinations are
    collected). A cell of a replicate has one row per block of block_slots draws, whose w add up. All metrics over the
    result share the same draws. No rows give no replicates.
    """
    spark = rows.sparkSession
    sizes = rows if "n" in rows.columns else cell_counts(rows, cell)
    counts = sizes.orderBy(*(F.asc_nulls_first(c) for c in order)).collect()
    total = sum(r["n"] for r in counts)
    names = spark.createDataFrame([(i, *(r[c] for c in cell)) for i, r in enumerate(counts)], "k int, " + ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in cell))
    begins, blocks = thresholds([r["n"] for r in counts]) if total else None, max(1, -(-total // block_slots))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for b, block in zip(part["id"] // blocks, part["id"] % blocks):
                own = drawn(seed, int(b), int(block) * block_slots, min(total, (int(block) + 1) * block_slots))
                w = np.bincount(np.searchsorted(begins, own, side="right"), minlength=len(counts))
                yield pd.DataFrame({"b": int(b), "k": np.arange(len(w)), "w": w})[w > 0]

    each = spark.range(replicates * blocks if total else 0).mapInPandas(run, "b int, k int, w long")
    return each.join(F.broadcast(names), "k").select("b", *cell, "w")  # as many names as cells


CELL = ["y_true", "y_pred", "t_true", "t_pred"]


def replicate_metrics(draws: DataFrame, by: list[str] = []) -> DataFrame:
    """Per replicate the seven headline metrics."""
    w = F.col("w")
    c = scores.cells(w)
    tp, fp, fn, tn = c["tp"], c["fp"], c["fn"], c["tn"]
    joint = scores.ratio(F.sum(F.when(scores.joint_correct(), w).otherwise(0)), F.sum(w))
    wide = draws.groupBy(*by, "b").agg(scores.ratio(tp, tp + fp).alias("precision"), scores.ratio(tp, tp + fn).alias("recall"), scores.f1(tp, fp, fn).alias("f1"), scores.macro_f1(tp, fp, fn, tn).alias("macro_f1"),
                                        scores.ratio(tp + tn, F.sum(w)).alias("accuracy"), joint.alias("joint_accuracy"), *scores.typology_cells(w))
    return wide.select(*by, "b", "precision", "recall", "f1", "macro_f1", "accuracy", F.when(F.col("n_eval") > 0, scores.typology_macro()).otherwise(0.0).alias("typology_macro_f1"), "joint_accuracy")


def intervals(values: DataFrame, by: list[str], column: str = "value", level: float = 0.95) -> DataFrame:
    """(by..., mean, low, high, n): mean and linearly interpolated quantiles; nulls and NaN are dropped."""
    tail, clean = (1 - level) / 2, values.where(F.col(column).isNotNull() & ~F.isnan(column))
    return clean.groupBy(*by).agg(F.round(F.avg(column), 9).alias("mean"), F.round(F.percentile(column, F.lit(tail)), 9).alias("low"), F.round(F.percentile(column, F.lit(1 - tail)), 9).alias("high"), F.count(F.lit(1)).alias("n"))


METRICS = ["precision", "recall", "f1", "macro_f1", "accuracy", "typology_macro_f1", "joint_accuracy"]


def bootstrap_intervals(aligned: DataFrame, *, replicates: int = 1000, seed: int = 42, metrics: list[str] = METRICS) -> DataFrame:
    """(metric, mean, low, high, n) of the headline metrics, all from the same draws."""
    each = replicate_metrics(resample(plain_types(aligned), CELL, order=CELL, replicates=replicates, seed=seed))
    long = each.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))).alias("m")).select("m.*")
    return intervals(long, ["metric"])


def sweep_intervals(aligned: DataFrame, *, replicates: int = 100, representative: int = 42, full: int = 1000, seed: int = 42, some: int = 10, block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """(seed, split, metric, mean, low, high, n): bootstrap_intervals of every seed and split of a sweep.

    The representative seed has `full` replicates. Slot j of replicate b draws the same for all seeds of a split and is
    hashed once for them. A group is a split, `some` replicates and a block of slots.
    """
    cell = ["seed", "split", *CELL]
    sizes = plain_types(aligned).groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    totals = sizes.groupBy("seed", "split").agg(F.sum("n").alias("total"))
    wanted = F.when(F.col("seed") == representative, full).otherwise(replicates)
    work = totals.select("seed", "split", F.explode(F.sequence(F.lit(0), F.floor((wanted - 1) / some).cast("int"))).alias("part"), F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / block_slots)).alias("blocks"))
    tasks = 4 * aligned.sparkSession.sparkContext.defaultParallelism
    each = sizes.join(work.select("seed", "split", "part", F.explode("blocks").alias("block")), ["seed", "split"]).repartition(tasks, "split", "part", "block")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        out, part, first = [], int(own["part"].iloc[0]), int(own["block"].iloc[0]) * block_slots
        groups = []
        for number, g in own.groupby("seed"):
            g = g.sort_values(CELL, na_position="first")
            sizes_ = g["n"].tolist()
            groups.append((number, g[cell], sum(sizes_), thresholds(sizes_)))
        for b in range(part * some, (part + 1) * some):
            picks = drawn(seed, b, first, min(first + block_slots, max(total for _, _, total, _ in groups)))
            for number, g, total, begins in groups:
                if b < (full if number == representative else replicates):
                    w = np.bincount(np.searchsorted(begins, picks[: max(0, total - first)], side="right"), minlength=len(g))
                    out.append(g.assign(b=b, w=w)[w > 0])
        return pd.concat(out)[[*cell, "b", "w"]]

    kinds = ", ".join(f"{c} {aligned.schema[c].dataType.simpleString()}" for c in cell)
    metrics = replicate_metrics(each.groupBy("split", "part", "block").applyInPandas(run, f"{kinds}, b int, w long"), ["seed", "split"])
    long = metrics.select("seed", "split", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))).alias("m")).select("seed", "split", "m.*")
    return intervals(long, ["seed", "split", "metric"])


def kappa_interval(pairs: DataFrame, *, replicates: int = 1000, seed: int = 42) -> DataFrame:
    inside = pairs.where(F.col("a").isin(CONFLICT_TYPES) & F.col("b").isin(CONFLICT_TYPES))
    names = inside.select(F.col("a"), F.col("b").alias("b2"))
    each = resample(names, ["a", "b2"], order=["a", "b2"], replicates=replicates, seed=seed).select(F.col("b").alias("rep"), "a", F.col("b2").alias("b"), "w")
    value = kappa_cells(each, ["rep"], "w").select(kappa_value(F.col("n"), F.col("agree"), F.col("chance")).alias("value"))
    return intervals(value, [])


def paired_bootstrap(paired: DataFrame, *, a: list[str] = ["y_a"], b: list[str] = ["y_b"], replicates: int = 1000, seed: int = 42, centre: str = "mean") -> DataFrame:
    """One row: F1 of A and B and their difference, observed and with intervals, and the two-sided p of the difference.

    paired holds y_true and, in columns a and b, what the draws of either system predict for each row; a system's F1 is
    the mean over its draws. Both see the same resamples. p is the share of replicates whose distance from the centre
    (their mean, or the observed difference) reaches the centre's size.
    """
    def mean_f1(names: list[str], w: Column | None = None) -> Column:
        each = []
        for name in names:
            c = scores.cells(w, p=name)
            each.append(scores.f1(c["tp"], c["fp"], c["fn"]))
        return sum(each[1:], each[0]) / len(each)

    cell = ["y_true", *a, *b]
    sizes = cell_counts(paired, cell)
    each = resample(sizes, cell, order=cell, replicates=replicates, seed=seed).groupBy("b").agg(mean_f1(a, F.col("w")).alias("_a"), mean_f1(b, F.col("w")).alias("_c")).select("_a", "_c", (F.col("_a") - F.col("_c")).alias("d"))
    each = cut_lineage(each)  # one row per replicate
    points = sizes.agg(mean_f1(a, F.col("n")).alias("a"), mean_f1(b, F.col("n")).alias("b"), (mean_f1(a, F.col("n")) - mean_f1(b, F.col("n"))).alias("d")).first()
    seen = points["d"]
    at = F.lit(seen) if centre == "observed" else F.lit(each.agg(F.avg("d")).first()[0])
    r = lambda x, n: F.round(x, 9).alias(n)
    ends = [r(F.percentile(c, F.lit(q)), f"{end}_{name}") for c, name in (("_a", "a"), ("_c", "b")) for end, q in (("low", 0.025), ("high", 0.975))]
    out = each.agg(
        r(F.avg("_a"), "f1_a"), r(F.avg("_c"), "f1_b"), r(F.lit(points["a"]), "observed_a"), r(F.lit(points["b"]), "observed_b"), *ends, r(F.lit(seen), "observed"), r(F.avg("d"), "mean_difference"), r(F.percentile("d", F.lit(0.025)), "low"), r(F.percentile("d", F.lit(0.975)), "high"),
        r(F.avg((F.abs(F.col("d") - at) >= F.abs(at)).cast("double")), "p_value"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("p_text", F.when(F.col("p_value") == 0, F.concat(F.lit("< "), (1 / F.col("n")).cast("string"))).otherwise(F.col("p_value").cast("string")))
