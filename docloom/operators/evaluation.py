"""Metrics over aligned rows. Every operator takes `by`: the same query ungrouped, per system, split, seed or replicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import scores
from docloom.schemas import CONFLICT_TYPES, NO_TYPE

DIGITS = 9


def _round(x: F.Column, name: str) -> F.Column:
    return F.round(x, DIGITS).alias(name)


def binary_metrics(aligned: DataFrame, by: list[str] = []) -> DataFrame:
    """Precision, recall, F1, macro F1, accuracy and supports; empty input gives zeros (ungrouped) or no rows."""
    out = aligned.groupBy(*by).agg(*scores.binary(DIGITS))
    return out.fillna(0, ["n_conflict", "n_non_conflict"])


def roc_auc(aligned: DataFrame, by: list[str] = [], buckets: int = 1024) -> DataFrame:
    """Area under the ROC curve by ranks, ties sharing theirs; null if any confidence is null or a class is missing.

    Rows shrink to one per distinct score first. Scores in [0, 1] are ranked within buckets and the buckets' totals
    added, so that no task holds all scores.
    """
    y = F.col("y_true").cast("long")
    per_score = aligned.groupBy(*by, "conf").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    per_score = per_score.withColumn("b", F.least(F.lit(buckets), F.greatest(F.lit(0), F.floor(F.col("conf") * buckets))).cast("int"))
    totals = per_score.groupBy(*by, "b").agg(F.sum("neg").alias("bn"))
    before = Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("base", F.coalesce(F.sum("bn").over(before), F.lit(0))).select(*by, "b", "base")
    own = Window.partitionBy(*by, "b").orderBy("conf").rowsBetween(Window.unboundedPreceding, -1)
    keys = [per_score[k].eqNullSafe(totals[k]) for k in [*by, "b"]]
    joined = per_score.withColumn("own", F.coalesce(F.sum("neg").over(own), F.lit(0)))
    keys = [joined[k].eqNullSafe(totals[k]) for k in [*by, "b"]]
    ranked = joined.join(totals, keys).select(*(joined[k] for k in by), "conf", "pos", "neg", (F.col("base") + F.col("own")).alias("below"))
    area = scores.ratio(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg"))
    usable = (F.count_if(F.col("conf").isNull()) == 0) & (F.sum("pos") > 0) & (F.sum("neg") > 0)
    return ranked.groupBy(*by).agg(F.round(F.when(usable, area), DIGITS).alias("roc_auc"))


def typology_per_class(aligned: DataFrame, by: list[str] = []) -> DataFrame:
    """Per type: precision, recall, F1, support over the true conflicts; a missing prediction is a wrong one."""
    wide = aligned.groupBy(*by).agg(*scores.typology_cells()).fillna(0)
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("conflict_type"), F.col(f"t{i}").alias("t"), F.col(f"p{i}").alias("p"), F.col(f"s{i}").alias("s")) for i, c in enumerate(CONFLICT_TYPES)))).alias("x")
    t, p, s = F.col("t"), F.col("p"), F.col("s")
    return wide.select(*by, each).select(*by, "x.*").select(*by, "conflict_type", _round(scores.ratio(t, p), "precision"), _round(scores.ratio(t, s), "recall"), _round(scores.f1(t, p - t, s - t), "f1"), s.cast("long").alias("support"))


def typology_macro(aligned: DataFrame, by: list[str] = [], present_only: bool = False) -> DataFrame:
    """Macro F1 (over all four types, or those present) and accuracy over the true conflicts; null where there are none."""
    wide = aligned.groupBy(*by).agg(*scores.typology_cells()).fillna(0)
    some = F.col("n_eval") > 0
    return wide.select(*by, F.round(F.when(some, scores.typology_macro(present_only)), DIGITS).alias("macro_f1"), F.round(F.when(some, scores.ratio(F.col("right"), F.col("n_eval"))), DIGITS).alias("accuracy"), F.col("n_eval").cast("long").alias("n_eval"))


def typology_confusion(aligned: DataFrame, by: list[str] = []) -> DataFrame:
    """All 4 x 4 cells (true, predicted, n), zeros included; missing predictions are in no cell."""
    hit = F.col("y_true") & F.col("t_true").isin(CONFLICT_TYPES) & F.col("t_pred").isin(CONFLICT_TYPES)
    names = [(a, b) for a in CONFLICT_TYPES for b in CONFLICT_TYPES]
    counts = [F.count_if(hit & (F.col("t_true") == a) & (F.col("t_pred") == b)) for a, b in names]
    cells = F.array(*(F.struct(F.lit(a).alias("true_type"), F.lit(b).alias("pred_type"), n.alias("n")) for (a, b), n in zip(names, counts)))
    return aligned.groupBy(*by).agg(cells.alias("cells")).select(*by, F.explode("cells").alias("c")).select(*by, "c.*")


def joint_exact_match(aligned: DataFrame, by: list[str] = []) -> DataFrame:
    return aligned.groupBy(*by).agg(F.round(scores.ratio(F.count_if(scores.joint_correct()), F.count(F.lit(1))), DIGITS).alias("joint_accuracy"), F.count(F.lit(1)).alias("n"))


def per_jurisdiction_pair(aligned: DataFrame, by: list[str] = []) -> DataFrame:
    c = scores.cells()
    tp, fp, fn, tn = c["tp"], c["fp"], c["fn"], c["tn"]
    return aligned.groupBy(*by, "jurisdictions").agg(F.count(F.lit(1)).alias("support"), (tp + fn).cast("long").alias("n_conflict"), _round(scores.f1(tp, fp, fn), "f1"), _round(scores.macro_f1(tp, fp, fn, tn), "macro_f1"))


def one_vs_rest(aligned: DataFrame, by: list[str] = []) -> DataFrame:
    """F1 of each type against everything else, over all rows (documented by the reference's configuration only)."""
    said = F.when(F.col("y_pred"), F.coalesce("t_pred", F.lit(NO_TYPE)))
    parts = []
    for c in CONFLICT_TYPES:
        t, p = F.coalesce(F.col("t_true") == c, F.lit(False)), F.coalesce(said == c, F.lit(False))
        parts.append(F.struct(F.lit(c).alias("conflict_type"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn")))
    out = aligned.groupBy(*by).agg(F.array(*parts).alias("a")).select(*by, F.explode("a").alias("c")).select(*by, "c.*")
    return out.select(*by, "conflict_type", "tp", "fp", "fn", _round(scores.f1(F.col("tp"), F.col("fp"), F.col("fn")), "f1"))


def same_or_cross(aligned: DataFrame, by: list[str] = []) -> DataFrame:
    """Binary metrics of pairs within one jurisdiction and across two."""
    sides = F.split("jurisdictions", "__")
    return binary_metrics(aligned.withColumn("scope", F.when(sides[0] == sides[1], "same").otherwise("cross")), [*by, "scope"])


def recall_by_severity(aligned: DataFrame, by: list[str] = []) -> DataFrame:
    caught = F.count_if(F.col("y_pred"))
    return aligned.where("y_true").groupBy(*by, "severity").agg(caught.alias("caught"), F.count(F.lit(1)).alias("total"), _round(scores.ratio(caught, F.count(F.lit(1))), "recall"))


def system_confusion(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """TP, FP, FN, TN per system over the pairs that have a prediction (missing ones are skipped)."""
    joined = gold.join(predictions.select("system", "pair_id", "y_pred"), "pair_id")
    return joined.groupBy("system").agg(*(c.cast("long").alias(n) for n, c in scores.cells().items()))


def hard_positives(gold: DataFrame, predictions: DataFrame, n_systems: int) -> DataFrame:
    """Conflicts that at least all systems but one missed; a system without prediction is skipped."""
    said = gold.where("y_true").join(predictions.select("system", "pair_id", "y_pred"), "pair_id")
    missed = said.groupBy("ord", "pair_id").agg(F.count_if(~F.col("y_pred")).alias("missed_by"))
    return missed.where(F.col("missed_by") >= max(1, n_systems - 1))


def recall_by_class(gold: DataFrame, predictions: DataFrame, systems: list[str]) -> DataFrame:
    """(system, type, caught, total): a missing prediction is a miss. Systems are a short literal list."""
    asked = gold.where("y_true").withColumn("system", F.explode(F.array(*map(F.lit, systems))))
    joined = asked.join(predictions.select("system", "pair_id", "y_pred"), ["system", "pair_id"], "left")
    return joined.groupBy("system", F.col("t_true").alias("conflict_type")).agg(F.count_if(F.coalesce("y_pred", F.lit(False))).alias("caught"), F.count(F.lit(1)).alias("total"))
