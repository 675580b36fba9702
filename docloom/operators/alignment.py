"""Gold labels against predictions: alignment, set checks, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.schemas import CONFLICT_TYPES


def is_conflict(column: Column | str = "record_type") -> Column:
    """True for conflict records; a missing type is none."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column) == "conflict", F.lit(False))


def jurisdiction_pair(a: Column, b: Column) -> Column:
    """Both jurisdictions in canonical order, '?' where one is missing."""
    a, b = F.coalesce(a, F.lit("?")), F.coalesce(b, F.lit("?"))
    return F.concat_ws("__", F.least(a, b), F.greatest(a, b))


def gold_rows(records: DataFrame, *, order: str = "record_no", keep: list[str] = []) -> DataFrame:
    """(ord, pair_id, y_true, t_true, jurisdictions, rationale, keep...): the true side of every record with a pair_id."""
    y = is_conflict()
    return records.where(F.col("pair_id").isNotNull()).select(
        F.col(order).alias("ord"), "pair_id", y.alias("y_true"), F.when(y, F.col("conflict_type")).alias("t_true"),
        jurisdiction_pair(F.col("regime_a.jurisdiction"), F.col("regime_b.jurisdiction")).alias("jurisdictions"), "rationale", *keep)


def last_predictions(predictions: DataFrame, *, by: list[str] = [], order: str = "ord") -> DataFrame:
    """One prediction per pair_id (and `by`): the last in file order wins. Combines before its shuffle."""
    rest = [c for c in predictions.columns if c not in ("pair_id", order, *by)]
    return predictions.groupBy(*by, "pair_id").agg(F.max_by(F.struct(*rest), order).alias("p")).select(*by, "pair_id", "p.*")


def align(gold: DataFrame, predictions: DataFrame, *, order: str = "ord") -> DataFrame:
    """Gold left-joined with the last prediction of each pair_id; a missing one is (False, null, null) and `filled`.

    Repeated gold rows stay and get the same prediction each. Null pair_ids in the predictions match nothing.
    """
    last = last_predictions(predictions, order=order).select("pair_id", F.col("y_pred").alias("_y"), F.col("t_pred").alias("_t"), F.col("conf").alias("_c"), F.lit(True).alias("_there"))
    joined = gold.join(last, "pair_id", "left")
    return joined.select(*gold.columns, F.coalesce("_y", F.lit(False)).alias("y_pred"), F.col("_t").alias("t_pred"), F.col("_c").alias("conf"), F.col("_there").isNull().alias("filled"))


def missing_ids(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """pair_ids of gold without prediction."""
    return gold.select("pair_id").distinct().join(predictions.select("pair_id"), "pair_id", "left_anti")


def extra_ids(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """pair_ids predicted but not in gold."""
    return predictions.where(F.col("pair_id").isNotNull()).select("pair_id").distinct().join(gold.select("pair_id"), "pair_id", "left_anti")


def types_without_conflict(predictions: DataFrame, *, order: str = "ord") -> DataFrame:
    """Predictions that name a type although they see no conflict."""
    return last_predictions(predictions, order=order).where(~F.coalesce("y_pred", F.lit(False)) & F.col("t_pred").isNotNull()).select("pair_id", "t_pred")


def validation_summary(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: distinct ids of both sides, aligned, missing, extra, and types named without conflict."""
    both = gold.select("pair_id", F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(predictions.where(F.col("pair_id").isNotNull()).select("pair_id", F.lit(0).alias("g"), F.lit(1).alias("p")))
    ids = both.groupBy("pair_id").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    counted = ids.agg(F.sum("g").alias("n_gold"), F.sum("p").alias("n_predicted"), F.sum(F.col("g") * F.col("p")).alias("n_aligned"),
                      F.sum(F.col("g") * (1 - F.col("p"))).alias("n_missing"), F.sum(F.col("p") * (1 - F.col("g"))).alias("n_extra"))
    odd = types_without_conflict(predictions).agg(F.count(F.lit(1)).alias("n_type_without_conflict"))
    both_rows = counted.unionByName(odd, allowMissingColumns=True)
    return both_rows.agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in both_rows.columns))


def require_predictions(predictions: DataFrame) -> DataFrame:
    """The predictions unchanged; raises if a required field is null anywhere."""
    bad = predictions.where(F.col("pair_id").isNull() | F.col("y_pred").isNull()).limit(1).count()
    if bad:
        raise ValueError("predictions need pair_id and predicted_conflict_present")
    return predictions


def errors(aligned: DataFrame, snippet: int = 240) -> DataFrame:
    """Rows where the prediction is wrong: the conflict itself, or the type of a true conflict."""
    wrong = (F.col("y_true") != F.col("y_pred")) | (F.col("y_true") & ~F.col("t_true").eqNullSafe(F.col("t_pred")))
    return aligned.where(wrong).select("ord", "pair_id", "jurisdictions", "y_true", "y_pred", "t_true", "t_pred", "conf", F.substring(F.coalesce("rationale", F.lit("")), 1, snippet).alias("rationale"))


def model_name(predictions: DataFrame, given: str | None = None, *, order: str = "ord") -> DataFrame:
    """One row: the name given, else the first non-empty one in the predictions, else unknown_model."""
    named = predictions.where(F.col("model_name").isNotNull() & (F.col("model_name") != ""))
    return named.agg(F.min_by("model_name", order).alias("n")).select(F.coalesce(F.lit(given), "n", F.lit("unknown_model")).alias("model_name"))


def type_id(column: str) -> Column:
    """0-3 for the four types, -100 for none; anything else is an error."""
    at = F.array_position(F.array(*map(F.lit, CONFLICT_TYPES)), F.col(column))
    return F.when(F.col(column).isNull(), -100).when(at > 0, (at - 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("unknown type "), F.col(column))))
