"""Scores as columns over aligned rows (y_true, y_pred, t_true, t_pred, conf): the same for any grouping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.schemas import CONFLICT_TYPES


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _count(condition: Column, weight: Column | None) -> Column:
    return F.sum(F.when(condition, F.lit(1) if weight is None else weight).otherwise(0))


def cells(weight: Column | None = None, y: str = "y_true", p: str = "y_pred") -> dict[str, Column]:
    y_, p_ = F.col(y), F.col(p)
    return {"tp": _count(y_ & p_, weight), "fp": _count(~y_ & p_, weight), "fn": _count(y_ & ~p_, weight), "tn": _count(~y_ & ~p_, weight)}


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def macro_f1(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Mean F1 over the labels present in truth or prediction."""
    pos, neg = (tp + fp + fn > 0).cast("int"), (tn + fp + fn > 0).cast("int")
    return ratio(f1(tp, fp, fn) * pos + f1(tn, fn, fp) * neg, pos + neg)


def binary(digits: int = 9, weight: Column | None = None) -> list[Column]:
    """Aggregates: precision, recall, f1, macro_f1, accuracy, supports."""
    c = cells(weight)
    tp, fp, fn, tn = c["tp"], c["fp"], c["fn"], c["tn"]
    r = lambda x, name: F.round(x, digits).alias(name)
    return [r(ratio(tp, tp + fp), "precision"), r(ratio(tp, tp + fn), "recall"), r(f1(tp, fp, fn), "f1"), r(macro_f1(tp, fp, fn, tn), "macro_f1"),
            r(ratio(tp + tn, tp + fp + fn + tn), "accuracy"), (tp + fn).cast("long").alias("n_conflict"), (fp + tn).cast("long").alias("n_non_conflict")]


def joint_correct() -> Column:
    """Right iff the conflict is predicted right and so is its type (no conflict: no type named)."""
    y, p, t, s = F.col("y_true"), F.col("y_pred"), F.col("t_true"), F.col("t_pred")
    return (y == p) & F.when(y, t.eqNullSafe(s)).otherwise(s.isNull())


def typology_cells(weight: Column | None = None) -> list[Column]:
    """Per type true positives, predicted, support among the true conflicts, as t<i>, p<i>, s<i>; and the number right."""
    y, t, s, out = F.col("y_true"), F.col("t_true"), F.col("t_pred"), []
    for i, c in enumerate(CONFLICT_TYPES):
        out += [_count(y & t.eqNullSafe(F.lit(c)) & s.eqNullSafe(F.lit(c)), weight).alias(f"t{i}"), _count(y & s.eqNullSafe(F.lit(c)), weight).alias(f"p{i}"), _count(y & t.eqNullSafe(F.lit(c)), weight).alias(f"s{i}")]
    return out + [_count(y & t.isNotNull() & t.eqNullSafe(s), weight).alias("right"), _count(y, weight).alias("n_eval")]


def typology_macro(present_only: bool = False) -> Column:
    """Macro F1 from typology_cells: over all four types, or over those present in truth or prediction."""
    each = [f1(F.col(f"t{i}"), F.col(f"p{i}") - F.col(f"t{i}"), F.col(f"s{i}") - F.col(f"t{i}")) for i in range(4)]
    if not present_only:
        return sum(each[1:], each[0]) / 4
    there = [((F.col(f"p{i}") + F.col(f"s{i}")) > 0).cast("int") for i in range(4)]
    return ratio(sum((e * t for e, t in zip(each[1:], there[1:])), each[0] * there[0]), sum(there[1:], there[0]))
