"""Views of the test tables that stand for the engine's inputs: gold labels, prediction files, annotators, attempts.

Each view has the same definition twice: as a DataFrame and as SQL text for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import alignment
from docloom.plans.runtime import table
from docloom.schemas import CONFLICT_TYPES

SYSTEMS = {"s0": 5, "s1": 12, "s2": 20, "s3": 30, "s4": 45}
TYPES_SQL = "[" + ", ".join(f"'{c}'" for c in CONFLICT_TYPES) + "]"


def h(tag: str, *columns: str) -> Column:
    """A number from the first eight hex digits of md5('tag|...')."""
    key = F.concat_ws("|", F.lit(tag), *(F.col(c).cast("string") for c in columns))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def h_sql(tag: str, *columns: str) -> str:
    key = " || '|' || ".join([f"'{tag}'", *(f"{c}::VARCHAR" for c in columns)])
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"


def records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labelled_pairs")


def gold(spark: SparkSession, d: str, keep: list[str] = []) -> DataFrame:
    return alignment.gold_rows(records(spark, d), keep=keep)


GOLD = """gold AS (SELECT record_no AS ord, pair_id, coalesce(record_type = 'conflict', FALSE) AS y_true, CASE WHEN record_type = 'conflict' THEN conflict_type END AS t_true,
  least(coalesce(regime_a.jurisdiction, '?'), coalesce(regime_b.jurisdiction, '?')) || '__' || greatest(coalesce(regime_a.jurisdiction, '?'), coalesce(regime_b.jurisdiction, '?')) AS jurisdictions,
  rationale, split, severity FROM labelled_pairs WHERE pair_id IS NOT NULL)"""


def predictions(spark: SparkSession, d: str, systems: list[str] = ["s1"]) -> DataFrame:
    """(system, ord, pair_id, y_pred, t_pred, conf): answers derived from the labels by hashes, with gaps, repeats, strays."""
    base = gold(spark, d).groupBy("pair_id").agg(F.min("ord").alias("first"), F.min_by("y_true", "ord").alias("y"), F.min_by(F.struct("t_true"), "ord").alias("t"))
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("system"), F.lit(SYSTEMS[s]).alias("rate")) for s in systems))).alias("s")
    types = F.array(*map(F.lit, CONFLICT_TYPES))

    def own(tag: str) -> Column:
        return F.conv(F.substring(F.md5(F.concat(F.lit(tag), "system", F.lit("|"), "pair_id")), 1, 8), 16, 10).cast("long")

    rows = base.select("pair_id", "first", "y", "t", each).select("pair_id", "first", "y", "t", "s.*").where(own("drop") % 17 != 0)
    rows = rows.withColumn("y_pred", F.when(own("flip") % 100 < F.col("rate"), ~F.col("y")).otherwise(F.col("y")))
    any_type = F.get(types, (own("kind") % 4).cast("int"))
    kind = F.when(F.col("y_pred") & ((own("type") % 100 < 30) | F.col("t.t_true").isNull()), any_type).when(F.col("y_pred"), F.col("t.t_true")).when(own("odd") % 23 == 0, F.lit(CONFLICT_TYPES[0]))
    rows = rows.select("system", F.col("first").alias("ord"), "pair_id", "y_pred", kind.alias("t_pred"), (own("conf") % 1000 / F.lit(1000.0)).alias("conf"), (own("twice") % 19 == 0).alias("twice"))
    main = F.struct("ord", "y_pred", "t_pred")
    again = F.when(F.col("twice"), F.struct((F.col("ord") + 1000000000).alias("ord"), (~F.col("y_pred")).alias("y_pred"), F.lit(None).cast("string").alias("t_pred")))
    out = rows.select("system", "pair_id", "conf", F.explode(F.array_compact(F.array(main, again))).alias("r")).select("system", "r.ord", "pair_id", "r.y_pred", "r.t_pred", "conf")
    stray = spark.range(1, 6).select(each, (F.col("id") + 2000000000).alias("ord"), F.concat(F.lit("extra-"), F.col("id").cast("string")).alias("pair_id")).select("s.system", "ord", "pair_id", F.lit(True).alias("y_pred"), F.lit(CONFLICT_TYPES[0]).alias("t_pred"), F.lit(0.5).alias("conf"))
    return out.unionByName(stray)


def predictions_sql(systems: list[str] = ["s1"]) -> str:
    parts = []
    for s in systems:
        parts.append(f"""main_{s} AS (SELECT '{s}' AS system, first AS ord, pair_id, y_pred, CASE WHEN y_pred AND ({h_sql('type' + s, 'pair_id')} % 100 < 30 OR t IS NULL) THEN {TYPES_SQL}[{h_sql('kind' + s, 'pair_id')} % 4 + 1]
    WHEN y_pred THEN t WHEN {h_sql('odd' + s, 'pair_id')} % 23 = 0 THEN '{CONFLICT_TYPES[0]}' END AS t_pred, {h_sql('conf' + s, 'pair_id')} % 1000 / 1000.0::DOUBLE AS conf
  FROM (SELECT *, CASE WHEN {h_sql('flip' + s, 'pair_id')} % 100 < {SYSTEMS[s]} THEN NOT y ELSE y END AS y_pred FROM base WHERE {h_sql('drop' + s, 'pair_id')} % 17 <> 0)),
own_{s} AS (SELECT * FROM main_{s} UNION ALL SELECT system, ord + 1000000000, pair_id, NOT y_pred, NULL, conf FROM main_{s} WHERE {h_sql('twice' + s, 'pair_id')} % 19 = 0
  UNION ALL SELECT '{s}', i + 2000000000, 'extra-' || i::VARCHAR, TRUE, '{CONFLICT_TYPES[0]}', 0.5 FROM range(1, 6) r(i))""")
    base = "base AS (SELECT pair_id, ord AS first, y_true AS y, t_true AS t FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY ord) AS rn FROM gold) WHERE rn = 1)"
    union = "pred AS (" + " UNION ALL ".join(f"SELECT * FROM own_{s}" for s in systems) + ")"
    last = "last AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY system, pair_id ORDER BY ord DESC) AS rn FROM pred) WHERE rn = 1)"
    return ",\n".join([GOLD, base, *parts, union, last])


def aligned(spark: SparkSession, d: str, system: str = "s1") -> DataFrame:
    return alignment.align(gold(spark, d, ["split", "severity"]), predictions(spark, d, [system]).drop("system"))


def aligned_sql(system: str = "s1") -> str:
    return predictions_sql([system]) + """,
aligned AS (SELECT gold.*, coalesce(last.y_pred, FALSE) AS y_pred, last.t_pred, last.conf, last.pair_id IS NULL AS filled FROM gold LEFT JOIN last USING (pair_id))"""


def annotators(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(pair_id, label) twice: the first and the last pass over each item."""
    passes = table(spark, d, "annotation_passes").where("pair_id is not null")
    label = F.regexp_replace(F.lower(F.trim("conflict_type")), "[ -]+", "_")
    rows = passes.select("pair_id", "pass_no", F.struct(label.alias("label")).alias("l"))
    ends = rows.groupBy("pair_id").agg(F.min_by("l", "pass_no").alias("a"), F.max_by("l", "pass_no").alias("b"), F.count(F.lit(1)).alias("n"))
    return ends.select("pair_id", F.col("a.label").alias("label")), ends.where("n > 1").select("pair_id", F.col("b.label").alias("label"))


ANNOTATORS = """passes AS (SELECT pair_id, pass_no, regexp_replace(lower(trim(conflict_type)), '[ -]+', '_', 'g') AS label, row_number() OVER (PARTITION BY pair_id ORDER BY pass_no) AS i, row_number() OVER (PARTITION BY pair_id ORDER BY pass_no DESC) AS j FROM annotation_passes WHERE pair_id IS NOT NULL),
ann1 AS (SELECT pair_id, label AS a FROM passes WHERE i = 1),
ann2 AS (SELECT pair_id, label AS b FROM passes WHERE j = 1 AND i > 1),
pairs AS (SELECT pair_id, a, b, CASE WHEN ann1.pair_id IS NULL THEN 'only_2' WHEN ann2.pair_id IS NULL THEN 'only_1' ELSE 'both' END AS side FROM ann1 FULL JOIN ann2 USING (pair_id))"""


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """(pair_id, attempt_n, temperature, latency_seconds, content): model answers of all sorts, up to three per pair."""
    base = gold(spark, d).groupBy("pair_id").agg(F.min_by(F.struct("y_true", "t_true"), "ord").alias("g"))
    each = base.select("pair_id", "g.*", F.explode(F.array(*map(F.lit, range(3)))).alias("attempt_n")).where((F.col("attempt_n") == 0) | (h("more", "pair_id") % 3 >= F.col("attempt_n")))
    kind = h("kind", "pair_id", "attempt_n") % 8
    typed = F.coalesce("t_true", F.lit(CONFLICT_TYPES[1]))
    text = (F.when(kind == 0, F.concat(F.lit('Sure.\n```json\n{"conflict_present": '), F.col("y_true").cast("string"), F.lit(', "conflict_type": '), F.when(F.col("y_true"), F.concat(F.lit('"'), typed, F.lit('"'))).otherwise("null"), F.lit(', "rationale": "a {b} \\"c\\""}\n```')))
            .when(kind == 1, F.lit("I cannot tell.")).when(kind == 2, F.lit('{"conflict_type": null}')).when(kind == 3, F.lit('{"conflict_present": "maybe", "conflict_type": null}'))
            .when(kind == 4, F.concat(F.lit('\\boxed{{"conflict_present": "True", "conflict_type": "Type: '), F.upper(typed), F.lit('"}}'))).when(kind == 5, F.lit('{"conflict_present": false, "conflict_type": "recurring_friction"}'))
            .when(kind == 6, F.lit('{"conflict_present": true, "conflict_type": "recurring_friction or structural_unresolved"}')).otherwise(F.lit('{"conflict_present": true, "conflict_type": ')))
    return each.select("pair_id", "attempt_n", F.get(F.array(*map(F.lit, (0.0, 0.3, 0.7))), F.col("attempt_n")).alias("temperature"), (h("slow", "pair_id", "attempt_n") % 100 / F.lit(10.0)).alias("latency_seconds"), text.alias("content"))


ATTEMPTS = GOLD + f""",
abase AS (SELECT pair_id, y_true, t_true FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY ord) AS rn FROM gold) WHERE rn = 1),
attempts AS (SELECT pair_id, y_true, t_true, n::INT AS attempt_n, {h_sql('kind', 'pair_id', 'n')} % 8 AS kind, [0.0, 0.3, 0.7][n + 1]::DOUBLE AS temperature, {h_sql('slow', 'pair_id', 'n')} % 100 / 10.0::DOUBLE AS latency FROM abase, range(3) r(n) WHERE n = 0 OR {h_sql('more', 'pair_id')} % 3 >= n),
parsed AS (SELECT *, kind IN (0, 4) AS success, CASE kind WHEN 0 THEN y_true WHEN 4 THEN TRUE END AS present, CASE WHEN kind = 0 AND y_true OR kind = 4 THEN coalesce(t_true, '{CONFLICT_TYPES[1]}') END AS ctype,
  CASE kind WHEN 1 THEN 'no_json_block_found' WHEN 2 THEN 'schema_missing_fields' WHEN 3 THEN 'schema_wrong_type' WHEN 5 THEN 'type_set_without_conflict' WHEN 6 THEN 'multiple_types_matched' WHEN 7 THEN 'no_json_block_found' END AS reason FROM attempts)"""
