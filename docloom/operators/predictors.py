"""Reference predictors: majority and stratified random, and the sweep over seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import scores
from docloom.operators import evaluation
from docloom.operators.alignment import is_conflict
from docloom.schemas import CONFLICT_TYPES

HEADLINE = ["precision", "recall", "f1", "macro_f1", "accuracy", "roc_auc", "typology_macro_f1", "typology_accuracy", "joint_accuracy"]


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of parts joined by '|': the same in every engine, and no state."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def majority_class(records: DataFrame, column: str, *, order: str = "record_no") -> DataFrame:
    """(value, n): the most frequent value; ties go to the one seen first."""
    counts = records.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(1).select("value", "n")


def majority_predict(train: DataFrame, rows: DataFrame, *, order: str = "record_no") -> DataFrame:
    """(ord, pair_id, y_pred, t_pred): the training majority for every row; a type only if the majority is conflict."""
    top = majority_class(train, "record_type", order=order).first()
    kind = majority_class(train.where(is_conflict()), "conflict_type", order=order).first()
    conflict = bool(top) and top["value"] == "conflict"
    return rows.select(F.col(order).alias("ord"), "pair_id", F.lit(conflict).alias("y_pred"), F.lit(kind["value"] if conflict and kind else None).cast("string").alias("t_pred"))


def class_priors(train: DataFrame) -> DataFrame:
    """One row: share of conflicts, and of each type among the conflicts that name one of the four."""
    y = is_conflict()
    typed = F.count_if(y & F.col("conflict_type").isin(CONFLICT_TYPES))
    shares = [F.round(scores.ratio(F.count_if(y & (F.col("conflict_type") == c)), typed), 9).alias(f"p_{c}") for c in CONFLICT_TYPES]
    return train.agg(F.round(scores.ratio(F.count_if(y), F.count(F.lit(1))), 9).alias("p_conflict"), *shares)


def stratified_predict(train: DataFrame, rows: DataFrame, seeds: list[int], *, order: str = "record_no", keep: list[str] = []) -> DataFrame:
    """(seed, ord, pair_id, y_pred, t_pred, conf, keep...): random predictions with the training shares, one set per seed.

    Without any typed conflict in training the types are uniform. All seeds are one job. What else is needed of a row
    goes along by keep: a join with the result has seeds times as many rows, which Spark's size estimates leave out.
    """
    p = class_priors(train).first()
    shares = [p[f"p_{c}"] for c in CONFLICT_TYPES]
    shares = shares if sum(shares) > 0 else [0.25] * 4
    seeded = rows.select(F.col(order).alias("ord"), "pair_id", *keep, F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    key = [F.col("seed").cast("string"), F.col("ord").cast("string")]
    y = uniform(F.lit("y"), *key) < p["p_conflict"]
    u, kind, total = uniform(F.lit("t"), *key), None, 0.0
    for c, share in list(zip(CONFLICT_TYPES, shares))[:-1]:
        total += share
        kind = F.when(u < total, c) if kind is None else kind.when(u < total, c)
    return seeded.select("seed", "ord", "pair_id", y.alias("y_pred"), F.when(y, kind.otherwise(CONFLICT_TYPES[-1])).alias("t_pred"), F.lit(p["p_conflict"]).alias("conf"), *keep)


def summarise(values: DataFrame, column: str, by: list[str] = []) -> DataFrame:
    """(mean, population std, min, max, n) over the non-null values."""
    r = lambda x, n: F.round(x, 9).alias(n)
    return values.groupBy(*by).agg(r(F.avg(column), "mean"), r(F.coalesce(F.stddev_pop(column), F.lit(0.0)), "std"), r(F.min(column), "min"), r(F.max(column), "max"), F.count(column).alias("n"))


def sweep_metrics(aligned: DataFrame, by: list[str] = ["seed", "split"]) -> DataFrame:
    """(by..., metric, value): the nine headline metrics of every seed and split; null where one is undefined."""
    parts = [evaluation.binary_metrics(aligned, by), evaluation.roc_auc(aligned, by), evaluation.typology_macro(aligned, by).select(*by, F.col("macro_f1").alias("typology_macro_f1"), F.col("accuracy").alias("typology_accuracy")), evaluation.joint_exact_match(aligned, by).drop("n")]
    wide = parts[0]
    for part in parts[1:]:
        wide = wide.join(part, by)
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in HEADLINE))).alias("m")
    return wide.select(*by, each).select(*by, "m.*")


def predicted_shares(predictions: DataFrame, by: list[str] = []) -> DataFrame:
    """(by..., label, n, share): what is predicted, pooled over seeds; shares within by."""
    label = F.when(F.col("y_pred"), F.coalesce("t_pred", F.lit("untyped"))).otherwise("non_conflict")
    counts = predictions.groupBy(*by, label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.select(*by, "label", "n", F.round(F.col("n") / total.cast("double"), 9).alias("share"))
