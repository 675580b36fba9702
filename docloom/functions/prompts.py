"""Prompts for labelling a pair of passages: three framings of the same question, and the grid of runs over them."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.replies import LETTERS, pair_fields, render
from docloom.schemas import CONFLICT_TYPES

_SIDES = "First passage ({jurisdiction_a}, {regime_a}):\n{passage_a}\n\nSecond passage ({jurisdiction_b}, {regime_b}):\n{passage_b}\n"
_ANSWER = 'Answer with one JSON object and nothing else. Its keys: "conflict_present" (true or false), "conflict_type" ({types}; null if there is no conflict), "rationale" (one or two sentences).'
_NAMES = ", ".join(f'"{c}"' for c in CONFLICT_TYPES)

#: What each type means, in one line.
MEANINGS = dict(zip(CONFLICT_TYPES, (
    "whoever obeys one rule breaks the other, and nothing in force resolves it",
    "both rules can be obeyed with a known instrument, such as a contract clause, a waiver or a licence",
    "the passages alone do not settle it: it turns on facts or on a reading not given here",
    "both rules can be obeyed, but doing so costs effort again and again")))

#: variant -> (system prompt, template of the user's prompt)
VARIANTS: dict[str, tuple[str, str]] = {
    "A": ("You compare legal texts.", f"Do these two passages make demands that compete with or contradict each other? If so, of what type?\n\n{_SIDES}\n" + _ANSWER.replace("{types}", "one of " + _NAMES)),
    "B": ("You work in compliance and classify conflicts between rules.",
          "Decide whether somebody bound by both passages faces a conflict, and of what type.\n\nTypes:\n" + "\n".join(f"* {k}: {v}." for k, v in MEANINGS.items()) + f"\n\n{_SIDES}\n" + _ANSWER.replace("{types}", "one of " + _NAMES)),
    "C": ("You are an experienced lawyer for financial regulation across borders and apply a fixed scheme of conflict types.",
          "Assess the two passages by this scheme.\n\n" + "\n".join(f"{letter} ({c}): {MEANINGS[c]}." for letter, c in LETTERS.items()) + f"\n\n{_SIDES}\n" + _ANSWER.replace("{types}", "the letter " + ", ".join(LETTERS))),
}


def rendered(records: DataFrame, variants: list[str] = list(VARIANTS), *, id_col: str = "record_no") -> DataFrame:
    """(id_col, variant, system, user): the prompts of every record; an unknown variant is an error."""
    unknown = [v for v in variants if v not in VARIANTS]
    if unknown:
        raise ValueError(f"unknown variants {unknown}; known are {list(VARIANTS)}")
    fields: dict[str, Column] = pair_fields()
    each = F.array(*(F.struct(F.lit(v).alias("variant"), F.lit(VARIANTS[v][0]).alias("system"), render(VARIANTS[v][1], fields).alias("user")) for v in variants))
    return records.select(id_col, F.explode(each).alias("p")).select(id_col, "p.*")


def grid(spark: SparkSession, models: list[str], splits: list[str], variants: list[str] = list(VARIANTS), *, only_models: list[str] | None = None, only_variants: list[str] | None = None, only_splits: list[str] | None = None, suffix: str = "") -> DataFrame:
    """(cell, model, variant, split, run_name, partial): the runs of a grid, in order; partial tells that the choice leaves
    models, variants or splits out or names its runs apart, so that no summary over the grid may be drawn from it."""
    chosen = [[x for x in have if only is None or x in only] for have, only in ((models, only_models), (variants, only_variants), (splits, only_splits))]
    partial = only_models is not None or only_variants is not None or len(chosen[2]) < len(splits) or bool(suffix)
    rows = [(i, m, v, s, f"{m}_{v}_{s}{suffix}".replace("/", "_").replace(" ", "_"), partial) for i, (m, v, s) in enumerate(product(*chosen))]
    return spark.createDataFrame(rows, "cell int, model string, variant string, split string, run_name string, partial boolean")
