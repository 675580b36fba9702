"""Model replies: prompts out of records, predictions out of answers, and what retries did."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.scores import ratio
from docloom.schemas import CONFLICT_TYPES

# The letters of the four types, and why a reply can fail.
LETTERS = dict(zip("ABCD", CONFLICT_TYPES))
FAILURES = ["no_json_block_found", "invalid_json", "schema_missing_fields", "schema_wrong_type", "multiple_types_matched", "unknown_conflict_type", "type_set_without_conflict", "all_retries_failed", "client_timeout"]


def passage(evidence: str) -> Column:
    """'[Chunk i, p.N]' and the text of every piece of evidence, blank lines between; the page is left out if 0 or null."""
    one = lambda x, i: F.concat(F.lit("[Chunk "), (i + 1).cast("string"), F.when(x["page"] != 0, F.concat(F.lit(", p."), x["page"].cast("string"))).otherwise(""), F.lit("]\n"), F.regexp_replace(F.coalesce(x["passage"], F.lit("")), r"(?U)^\s+|\s+\z", ""))
    return F.array_join(F.transform(F.coalesce(F.col(evidence), F.array().cast("array<struct<chunk_id:string,source_doc:string,page:int,passage:string>>")), one), "\n\n")


def render(template: str, fields: dict[str, Column]) -> Column:
    """A template with {name} places filled; what stands in a field is never read as a place."""
    parts, rest = [], template
    while True:
        spots = [(rest.find("{" + n + "}"), n) for n in fields if "{" + n + "}" in rest]
        if not spots:
            return F.concat(*parts, F.lit(rest))
        at, name = min(spots)
        parts += [F.lit(rest[:at]), F.coalesce(fields[name], F.lit("?"))]
        rest = rest[at + len(name) + 2 :]


def pair_fields() -> dict[str, Column]:
    sides = {}
    for s in "ab":
        sides |= {f"jurisdiction_{s}": F.col(f"regime_{s}.jurisdiction"), f"regime_{s}": F.col(f"regime_{s}.regime_id"), f"passage_{s}": passage(f"evidence_{s}")}
    return sides


def unwrap(text: Column | str) -> Column:
    """A reply without \\boxed{...}, code fences and outer space."""
    plain = F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")
    boxed = F.regexp_extract(plain, r"\\boxed\{([\s\S]*?)\}\s*\z", 1)
    plain = F.when(plain.rlike(r"\\boxed\{[\s\S]*?\}\s*\z"), F.trim(boxed)).otherwise(plain)
    return F.regexp_replace(F.regexp_replace(plain, r"```(?:json|JSON)?\s*\n?", ""), r"(?U)^\s+|\s+\z", "")


def first_object(text: str) -> str | None:
    """The first balanced {...}; braces in strings and after backslashes don't count."""
    start, depth, quoted, at = text.find("{"), 0, False, text.find("{")
    while 0 <= at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
            continue
        if c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : at + 1]
        at += 1
    return None


_FLAGS = ("valid", "has_present", "type_is_text")
_READ = ["block", "valid", "has_present", "present", "type", "type_is_text", "rationale"]


@F.pandas_udf(T.StructType([T.StructField(n, T.BooleanType() if n in _FLAGS else T.StringType()) for n in _READ]))
def _read(texts: pd.Series) -> pd.DataFrame:
    """The first object of each text, and its fields as text (booleans and strings apart from the rest by `type` of JSON)."""
    rows = []
    for t in texts:
        block = first_object(t or "")
        try:
            obj = json.loads(block) if block else None
        except ValueError:
            rows.append((block, False, False, None, None, False, None))
            continue
        if not isinstance(obj, dict):
            rows.append((block, block is not None, False, None, None, False, None))
            continue
        present, kind, why = obj.get("conflict_present"), obj.get("conflict_type"), obj.get("rationale")
        said = present.strip().lower() if isinstance(present, str) else str(present).lower() if isinstance(present, bool) else "?"
        rows.append((block, True, "conflict_present" in obj, said, None if kind is None else str(kind), isinstance(kind, str), None if why is None else why if isinstance(why, str) else str(why)))
    return pd.DataFrame(rows, columns=_READ)


def parse_replies(replies: DataFrame, *, text_col: str = "content", variant_col: str | None = None, variant: str = "A") -> DataFrame:
    """replies with success, conflict_present, conflict_type, rationale and failure_reason.

    Only finding the object needs Python; what it says is judged by columns. Types may be spelled in any case, stand
    within other words (one only), or, in variant C, be a letter; null, none and '' are no type.
    """
    which = F.col(variant_col) if variant_col else F.lit(variant)
    rows = replies.withColumn("_r", _read(unwrap(F.coalesce(F.col(text_col), F.lit("")))))
    raw, text = F.col("_r.type"), F.lower(F.trim("_r.type"))
    none = raw.isNull() | (F.col("_r.type_is_text") & text.isin("null", "none", ""))
    names = F.array(*map(F.lit, CONFLICT_TYPES))
    inside = F.filter(names, lambda t: F.contains(text, t))
    letter = F.nullif(F.regexp_extract(F.upper(raw), r"\b([ABCD])\b", 1), F.lit(""))
    by_letter = F.when(which == "C", F.create_map(*(x for k, v in LETTERS.items() for x in (F.lit(k), F.lit(v))))[letter])
    kind = F.when(none, None).when(text.isin(CONFLICT_TYPES), text).when(by_letter.isNotNull(), by_letter).when(F.size(inside) == 1, F.get(inside, F.lit(0)))
    present = F.col("_r.present") == "true"
    failure = (F.when(F.col("_r.block").isNull(), FAILURES[0]).when(~F.col("_r.valid"), FAILURES[1]).when(~F.col("_r.has_present"), FAILURES[2]).when(~F.col("_r.present").isin("true", "false"), FAILURES[3])
               .when(~none & ~F.col("_r.type_is_text"), FAILURES[3]).when(~none & kind.isNull() & (F.size(inside) > 1), FAILURES[4]).when(~none & kind.isNull(), FAILURES[5]).when(~present & kind.isNotNull(), FAILURES[6]))
    ok = failure.isNull()
    return rows.withColumns({"success": ok, "conflict_present": F.when(ok, present), "conflict_type": F.when(ok, kind), "rationale": F.when(ok, F.col("_r.rationale")), "failure_reason": failure}).drop("_r")


def first_success(attempts: DataFrame, keys: list[str], order: str = "attempt_n") -> DataFrame:
    """(keys..., n_attempts, n_retries, temperature, latency, ...): the earliest attempt that succeeded; none: a prediction
    of no conflict, with the last attempt's reason. Latencies sum over all attempts, missing ones as 0."""
    done = F.col("success")
    best = F.min_by(F.struct(F.col(order).alias("n"), "temperature", "conflict_present", "conflict_type"), F.when(done, F.col(order)))
    out = attempts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_attempts"), F.min(order).alias("_first"), F.when(F.max(done), best).alias("b"), F.round(F.sum(F.coalesce("latency_seconds", F.lit(0.0))), 6).alias("total_latency"), F.max_by("failure_reason", order).alias("_why"))
    return out.select(*keys, "n_attempts", (F.col("b.n") - F.col("_first")).alias("n_retries"), F.col("b.temperature").alias("succeeded_at"), F.coalesce("b.conflict_present", F.lit(False)).alias("y_pred"),
                      F.col("b.conflict_type").alias("t_pred"), "total_latency", F.when(F.col("b").isNull(), F.coalesce("_why", F.lit("all_retries_failed"))).alias("failure_reason"))


def retry_summary(outcomes: DataFrame) -> DataFrame:
    """One row: how many, the share that failed, and the counts by retries and by temperature of success."""
    retries = [F.count_if(F.col("n_retries") == k).alias(f"retries_{k}") for k in range(3)]
    temps = [F.count_if(F.round("succeeded_at", 1) == t).alias(f"at_{str(t).replace('.', '_')}") for t in (0.0, 0.3, 0.7)]
    failed = F.count_if(F.col("n_retries").isNull())
    return outcomes.agg(F.count(F.lit(1)).alias("n"), F.round(ratio(failed, F.count(F.lit(1))), 9).alias("failure_rate"), *retries, *temps, failed.alias("at_none"))


def attempt_ends(attempts: DataFrame, keys: list[str], columns: list[str], order: str = "attempt_n") -> DataFrame:
    """(keys..., first_<column>, last_<column> for each): what the first and the last attempt had."""
    return attempts.groupBy(*keys).agg(*(f(c, order).alias(f"{end}_{c}") for c in columns for end, f in (("first", F.min_by), ("last", F.max_by))))


def progress(outcomes: DataFrame, by: list[str], order: str, seconds: str = "total_latency") -> DataFrame:
    """(by..., order, done, total, mean_seconds, seconds_left): how far each group's run was after each answer, and what was
    left at the mean pace so far."""
    sofar = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    done, total = F.row_number().over(Window.partitionBy(*by).orderBy(order)), F.count(F.lit(1)).over(Window.partitionBy(*by))
    micros = F.round(F.coalesce(seconds, F.lit(0.0)) * 1_000_000).cast("long")  # whole numbers, so that the order of adding doesn't matter
    rows = outcomes.select(*by, order, done.alias("done"), total.alias("total"), (F.sum(micros).over(sofar) / done / 1_000_000).alias("_mean"))
    return rows.select(*by, order, "done", "total", F.round("_mean", 6).alias("mean_seconds"), F.round(F.col("_mean") * (F.col("total") - F.col("done")), 6).alias("seconds_left"))


def transcript_name(pair_id: str) -> Column:
    """A file name for a pair's transcript: colons and slashes become underscores."""
    return F.concat(F.translate(pair_id, ":/", "__"), F.lit(".json"))


_TRANSCRIPT = "attempts array<struct<temperature: double, parsed: struct<success: boolean, conflict_present: boolean, conflict_type: string>>>"


def resumed(transcripts: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(pair_id, n_attempts, n_retries, succeeded_at, y_pred, t_pred) of the transcripts that can be read: the first attempt
    that succeeded counts; none: no conflict. A transcript that is no JSON object is left out, to be computed again."""
    v = F.try_parse_json(text_col)
    whole = transcripts.where(v.isNotNull() & F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False)))
    tries = F.coalesce(F.from_json(text_col, _TRANSCRIPT)["attempts"], F.array().cast("array<struct<temperature: double, parsed: struct<success: boolean, conflict_present: boolean, conflict_type: string>>>"))
    numbers = F.transform(tries, lambda a, i: F.when(F.coalesce(a["parsed"]["success"], F.lit(False)), i))
    rows = whole.select("pair_id", tries.alias("tries"), F.array_min(F.array_compact(numbers)).alias("at"))
    best = F.get("tries", F.col("at"))
    return rows.select("pair_id", F.size("tries").alias("n_attempts"), F.coalesce("at", F.size("tries") - 1).alias("n_retries"), best["temperature"].alias("succeeded_at"), F.coalesce(best["parsed"]["conflict_present"], F.lit(False)).alias("y_pred"), best["parsed"]["conflict_type"].alias("t_pred"))


def still_to_ask(pairs: DataFrame, transcripts: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The pairs that no readable transcript answers."""
    return pairs.join(resumed(transcripts, text_col=text_col).select("pair_id"), "pair_id", "left_anti")
