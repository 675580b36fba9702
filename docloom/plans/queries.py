"""The engine's own queries over the test tables: name -> (DataFrame, SQL for the comparison engine or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import replies
from docloom.functions import text as T
from docloom.operators import alignment, dataset, evaluation, ingestion, predictors, statistics, structure, training, vectors
from docloom.plans import views as V
from docloom.plans.runtime import table
from docloom.streaming import incremental
from docloom.schemas import CONFLICT_TYPES, NON_CONFLICT_SUBTYPES
from docloom.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TYPES = ", ".join(f"'{c}'" for c in CONFLICT_TYPES)
REPLICATES = 1000
N_SEEDS = 100
SIX = list(V.SYSTEMS)


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- scores ------------------------------------------------------------------------------------------------------------

def _ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0.0)"


def _binary(weight: str = "1") -> dict[str, str]:
    n = {k: f"coalesce(sum({weight}) FILTER ({c}), 0)" for k, c in {"tp": "y_true AND y_pred", "fp": "NOT y_true AND y_pred", "fn": "y_true AND NOT y_pred", "tn": "NOT y_true AND NOT y_pred"}.items()}
    tp, fp, fn, tn = n["tp"], n["fp"], n["fn"], n["tn"]
    f1, f0 = _ratio(f"2*{tp}", f"2*{tp}+{fp}+{fn}"), _ratio(f"2*{tn}", f"2*{tn}+{fp}+{fn}")
    pos, neg = f"({tp}+{fp}+{fn} > 0)::INT", f"({tn}+{fp}+{fn} > 0)::INT"
    return {"precision": _ratio(tp, f"{tp}+{fp}"), "recall": _ratio(tp, f"{tp}+{fn}"), "f1": f1, "macro_f1": _ratio(f"{f1}*{pos}+{f0}*{neg}", f"{pos}+{neg}"), "accuracy": _ratio(f"{tp}+{tn}", f"{tp}+{fp}+{fn}+{tn}"),
            "n_conflict": f"({tp}+{fn})::BIGINT", "n_non_conflict": f"({fp}+{tn})::BIGINT"} | n


B = _binary()
_HEAD = ", ".join([f"round({B[k]}, 9) AS {k}" for k in ("precision", "recall", "f1", "macro_f1", "accuracy")] + [f"{B[k]} AS {k}" for k in ("n_conflict", "n_non_conflict")])


@query(f"WITH {V.aligned_sql()} SELECT {_HEAD} FROM aligned")
def binary_metrics(spark, d):
    return evaluation.binary_metrics(V.aligned(spark, d))


@query(f"WITH {V.aligned_sql()} SELECT split, {_HEAD} FROM aligned GROUP BY split")
def binary_metrics_by_split(spark, d):
    return evaluation.binary_metrics(V.aligned(spark, d), ["split"])


_AUC = """ranked AS (SELECT {by} y_true, conf, rank() OVER ({part} ORDER BY conf) + (count(*) OVER ({part2} conf) - 1) / 2.0 AS r FROM scored)
SELECT {by} CASE WHEN count(*) FILTER (conf IS NULL) = 0 AND bool_or(y_true) AND bool_or(NOT y_true) THEN round((sum(r) FILTER (y_true) - count(*) FILTER (y_true) * (count(*) FILTER (y_true) + 1) / 2.0) / (count(*) FILTER (y_true) * count(*) FILTER (NOT y_true)), 9) END AS roc_auc FROM ranked {group}"""


@query(f"WITH {V.aligned_sql()}, scored AS (SELECT * FROM aligned WHERE NOT filled), " + _AUC.format(by="", part="", part2="PARTITION BY", group=""))
def roc_auc(spark, d):
    return evaluation.roc_auc(V.aligned(spark, d).where("not filled"))


@query(f"WITH {V.aligned_sql()}, scored AS (SELECT * FROM aligned), " + _AUC.format(by="split,", part="PARTITION BY split", part2="PARTITION BY split,", group="GROUP BY split"))
def roc_auc_by_split(spark, d):
    return evaluation.roc_auc(V.aligned(spark, d), ["split"])


_CLASSES = f"classes AS (SELECT unnest([{TYPES}]) AS c)"
_PER_CLASS = f"""{_CLASSES}, per_class AS (SELECT c, count(*) FILTER (y_true AND t_true = c AND t_pred = c) AS t, count(*) FILTER (y_true AND t_pred = c) AS p, count(*) FILTER (y_true AND t_true = c) AS s FROM classes, aligned GROUP BY c)"""


@query(f"WITH {V.aligned_sql()}, {_PER_CLASS} SELECT c AS conflict_type, round({_ratio('t', 'p')}, 9) AS precision, round({_ratio('t', 's')}, 9) AS recall, round({_ratio('2*t', 'p+s')}, 9) AS f1, s AS support FROM per_class")
def typology_per_class(spark, d):
    return evaluation.typology_per_class(V.aligned(spark, d))


_MACRO = "(SELECT count(*) FROM aligned WHERE y_true) AS n_eval, (SELECT count(*) FROM aligned WHERE y_true AND t_true = t_pred) AS hits"


@query(f"WITH {V.aligned_sql()}, {_PER_CLASS}, tops AS (SELECT avg({_ratio('2*t', 'p+s')}) AS m, {_MACRO} FROM per_class) SELECT CASE WHEN n_eval > 0 THEN round(m, 9) END AS macro_f1, round(hits / nullif(n_eval, 0), 9) AS accuracy, n_eval FROM tops")
def typology_macro(spark, d):
    return evaluation.typology_macro(V.aligned(spark, d))


@query(f"WITH {V.aligned_sql()}, {_PER_CLASS}, tops AS (SELECT avg({_ratio('2*t', 'p+s')}) FILTER (p + s > 0) AS m, {_MACRO} FROM per_class) SELECT CASE WHEN n_eval > 0 THEN round(coalesce(m, 0), 9) END AS macro_f1, round(hits / nullif(n_eval, 0), 9) AS accuracy, n_eval FROM tops")
def typology_present(spark, d):
    return evaluation.typology_macro(V.aligned(spark, d), present_only=True)


@query(f"WITH {V.aligned_sql()}, {_CLASSES} SELECT x.c AS true_type, y.c AS pred_type, count(aligned.ord) AS n FROM classes x CROSS JOIN classes y LEFT JOIN aligned ON y_true AND t_true = x.c AND t_pred = y.c GROUP BY ALL")
def typology_confusion(spark, d):
    return evaluation.typology_confusion(V.aligned(spark, d))


_JOINT = "(y_true = y_pred AND CASE WHEN y_true THEN t_true IS NOT DISTINCT FROM t_pred ELSE t_pred IS NULL END)"


@query(f"WITH {V.aligned_sql()} SELECT round({_ratio(f'count(*) FILTER ({_JOINT})', 'count(*)')}, 9) AS joint_accuracy, count(*) AS n FROM aligned")
def joint_exact_match(spark, d):
    return evaluation.joint_exact_match(V.aligned(spark, d))


@query(f"WITH {V.aligned_sql()} SELECT jurisdictions, count(*) AS support, {B['n_conflict']} AS n_conflict, round({B['f1']}, 9) AS f1, round({B['macro_f1']}, 9) AS macro_f1 FROM aligned GROUP BY jurisdictions")
def per_jurisdiction_pair(spark, d):
    return evaluation.per_jurisdiction_pair(V.aligned(spark, d))


@query(f"WITH {V.aligned_sql()} SELECT ord, pair_id, jurisdictions, y_true, y_pred, t_true, t_pred, conf, substr(coalesce(rationale, ''), 1, 240) AS rationale FROM aligned WHERE y_true <> y_pred OR (y_true AND t_true IS DISTINCT FROM t_pred)")
def errors_list(spark, d):
    return alignment.errors(V.aligned(spark, d))


@query(f"WITH {V.predictions_sql()} SELECT DISTINCT pair_id FROM gold ANTI JOIN pred USING (pair_id)")
def validate_missing(spark, d):
    return alignment.missing_ids(V.gold(spark, d), V.predictions(spark, d))


@query(f"WITH {V.predictions_sql()} SELECT DISTINCT pair_id FROM pred ANTI JOIN gold USING (pair_id)")
def validate_extra(spark, d):
    return alignment.extra_ids(V.gold(spark, d), V.predictions(spark, d))


@query(f"WITH {V.predictions_sql()} SELECT pair_id, t_pred FROM last WHERE NOT coalesce(y_pred, FALSE) AND t_pred IS NOT NULL")
def validate_types(spark, d):
    return alignment.types_without_conflict(V.predictions(spark, d))


@query(f"""WITH {V.predictions_sql()}, g AS (SELECT DISTINCT pair_id FROM gold), p AS (SELECT DISTINCT pair_id FROM pred)
SELECT (SELECT count(*) FROM g) AS n_gold, (SELECT count(*) FROM p) AS n_predicted, (SELECT count(*) FROM g SEMI JOIN p USING (pair_id)) AS n_aligned, (SELECT count(*) FROM g ANTI JOIN p USING (pair_id)) AS n_missing,
(SELECT count(*) FROM p ANTI JOIN g USING (pair_id)) AS n_extra, (SELECT count(*) FROM last WHERE NOT y_pred AND t_pred IS NOT NULL) AS n_type_without_conflict""")
def validate_summary(spark, d):
    return alignment.validation_summary(V.gold(spark, d), V.predictions(spark, d))


@query(f"""WITH {V.aligned_sql()}, {_CLASSES}, said AS (SELECT c, coalesce(t_true = c, FALSE) AS t, coalesce(y_pred AND t_pred = c, FALSE) AS p FROM classes, aligned), n AS (SELECT c, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM said GROUP BY c)
SELECT c AS conflict_type, tp, fp, fn, round({_ratio('2*tp', '2*tp+fp+fn')}, 9) AS f1 FROM n""")
def one_vs_rest(spark, d):
    return evaluation.one_vs_rest(V.aligned(spark, d))


@query(f"WITH {V.aligned_sql()} SELECT CASE WHEN split_part(jurisdictions, '__', 1) = split_part(jurisdictions, '__', 2) THEN 'same' ELSE 'cross' END AS scope, {_HEAD} FROM aligned GROUP BY scope")
def same_or_cross(spark, d):
    return evaluation.same_or_cross(V.aligned(spark, d))


@query(f"WITH {V.aligned_sql()} SELECT severity, count(*) FILTER (y_pred) AS caught, count(*) AS total, round(count(*) FILTER (y_pred) / count(*), 9) AS recall FROM aligned WHERE y_true GROUP BY severity")
def recall_by_severity(spark, d):
    return evaluation.recall_by_severity(V.aligned(spark, d))


_LAST = V.predictions_sql(SIX)


@query(f"WITH {_LAST} SELECT system, {', '.join(f'{B[k]}::BIGINT AS {k}' for k in ('tp', 'fp', 'fn', 'tn'))} FROM gold JOIN last USING (pair_id) GROUP BY system")
def system_confusion(spark, d):
    return evaluation.system_confusion(V.gold(spark, d), alignment.last_predictions(V.predictions(spark, d, SIX), by=["system"]))


@query(f"WITH {_LAST} SELECT gold.ord, pair_id, count(*) FILTER (NOT y_pred) AS missed_by FROM gold JOIN last USING (pair_id) WHERE y_true GROUP BY ALL HAVING missed_by >= 4")
def hard_positives(spark, d):
    return evaluation.hard_positives(V.gold(spark, d), alignment.last_predictions(V.predictions(spark, d, SIX), by=["system"]), len(SIX))


@query(f"WITH {_LAST}, sys AS (SELECT unnest([{', '.join(repr(s) for s in SIX)}]) AS system) SELECT sys.system, t_true AS conflict_type, count(*) FILTER (coalesce(y_pred, FALSE)) AS caught, count(*) AS total FROM gold CROSS JOIN sys LEFT JOIN last ON last.system = sys.system AND last.pair_id = gold.pair_id WHERE y_true GROUP BY ALL")
def recall_by_class(spark, d):
    return evaluation.recall_by_class(V.gold(spark, d), alignment.last_predictions(V.predictions(spark, d, SIX), by=["system"]), SIX)


@query("SELECT conflict_type, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(*) FILTER (split = 'gold_iaa') AS gold_iaa FROM labelled_pairs WHERE record_type = 'conflict' GROUP BY conflict_type")
def class_by_split(spark, d):
    return V.records(spark, d).where(alignment.is_conflict()).groupBy("conflict_type").pivot("split", ["train", "val", "test", "gold_iaa"]).agg(F.count(F.lit(1))).fillna(0)


@query(f"WITH {V.GOLD} SELECT jurisdictions, count(*) AS n, min(ord) AS first FROM gold GROUP BY jurisdictions")
def pair_counts(spark, d):
    return V.gold(spark, d).groupBy("jurisdictions").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))


@query("SELECT DISTINCT ON (conflict_type) conflict_type, record_no, pair_id, regime_a.jurisdiction AS jurisdiction_a, regime_b.jurisdiction AS jurisdiction_b, substr(rationale, 1, 250) AS rationale FROM labelled_pairs WHERE record_type = 'conflict' AND conflict_type IS NOT NULL AND split = 'train' ORDER BY conflict_type, record_no")
def first_per_class(spark, d):
    rows = V.records(spark, d).where(alignment.is_conflict() & F.col("conflict_type").isNotNull() & (F.col("split") == "train"))
    one = F.struct("record_no", "pair_id", F.col("regime_a.jurisdiction").alias("jurisdiction_a"), F.col("regime_b.jurisdiction").alias("jurisdiction_b"), F.substring("rationale", 1, 250).alias("rationale"))
    return rows.groupBy("conflict_type").agg(F.min_by(one, "record_no").alias("r")).select("conflict_type", "r.*")


@query(f"WITH {V.predictions_sql()} SELECT ord, pair_id, CASE WHEN t_pred IS NULL THEN -100 ELSE list_position([{TYPES}], t_pred) - 1 END::INT AS type_id FROM last")
def type_ids(spark, d):
    return alignment.last_predictions(V.predictions(spark, d).withColumn("o", F.col("ord"))).select(F.col("o").alias("ord"), "pair_id", alignment.type_id("t_pred").alias("type_id"))


# -- predictors --------------------------------------------------------------------------------------------------------

_TRAIN = "train AS (SELECT * FROM labelled_pairs WHERE split = 'train'), other AS (SELECT * FROM labelled_pairs WHERE split <> 'train')"


def _train(spark, d):
    rows = V.records(spark, d)
    return rows.where("split = 'train'"), rows.where("split <> 'train'")


@query(f"WITH {_TRAIN} SELECT conflict_type AS value, count(*) AS n FROM train WHERE record_type = 'conflict' AND conflict_type IS NOT NULL GROUP BY value ORDER BY n DESC, min(record_no) LIMIT 1")
def majority_type(spark, d):
    return predictors.majority_class(_train(spark, d)[0].where(alignment.is_conflict()), "conflict_type")


@query(f"""WITH {_TRAIN}, top AS (SELECT record_type AS v FROM train WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, min(record_no) LIMIT 1), kind AS (SELECT conflict_type AS v FROM train WHERE record_type = 'conflict' AND v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, min(record_no) LIMIT 1)
SELECT record_no AS ord, pair_id, (SELECT v FROM top) = 'conflict' AS y_pred, CASE WHEN (SELECT v FROM top) = 'conflict' THEN (SELECT v FROM kind) END::VARCHAR AS t_pred FROM other""")
def majority_predict(spark, d):
    return predictors.majority_predict(*_train(spark, d))


_PRIORS = "priors AS (SELECT round(" + _ratio("count(*) FILTER (record_type = 'conflict')", "count(*)") + ", 9) AS p_conflict, " + ", ".join(
    "round(" + _ratio(f"count(*) FILTER (record_type = 'conflict' AND conflict_type = '{c}')", f"count(*) FILTER (record_type = 'conflict' AND conflict_type IN ({TYPES}))") + f", 9) AS p_{c}" for c in CONFLICT_TYPES) + " FROM train)"


@query(f"WITH {_TRAIN}, {_PRIORS} SELECT * FROM priors")
def class_priors(spark, d):
    return predictors.class_priors(_train(spark, d)[0])


def _u(tag: str) -> str:
    return f"(('0x' || substr(md5('{tag}|' || seed::VARCHAR || '|' || record_no::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_C = [f"p_{c}" for c in CONFLICT_TYPES]
_RANDOM = f"""{_TRAIN}, {_PRIORS}, rnd AS (SELECT seed::INT AS seed, record_no AS ord, pair_id, {_u('y')} < p_conflict AS y_pred, CASE WHEN {_u('y')} < p_conflict THEN CASE WHEN {_u('t')} < {_C[0]} THEN '{CONFLICT_TYPES[0]}' WHEN {_u('t')} < 0.0 + {_C[0]} + {_C[1]} THEN '{CONFLICT_TYPES[1]}'
  WHEN {_u('t')} < 0.0 + {_C[0]} + {_C[1]} + {_C[2]} THEN '{CONFLICT_TYPES[2]}' ELSE '{CONFLICT_TYPES[3]}' END END AS t_pred, p_conflict AS conf FROM other, priors, range(SEEDS) r(seed))"""


_RANDOM = _RANDOM.replace("SEEDS", str(N_SEEDS))


@query(f"WITH {_RANDOM} SELECT * FROM rnd")
def stratified_predict(spark, d):
    return predictors.stratified_predict(*_train(spark, d), list(range(N_SEEDS)))


#: Records of a task that makes a row of each per seed: their bytes alone would put all of them into one.
SWEEP_ROWS = 20_000


def _sweep(spark, d):
    """Predictions of all seeds with split and truth."""
    train, other = _train(spark, d)
    y = alignment.is_conflict()
    other = other.repartition(max(spark.sparkContext.defaultParallelism, -(-other.count() // SWEEP_ROWS)), "record_no")
    truth = other.select("record_no", "split", y.alias("y_true"), F.when(y, F.col("conflict_type")).alias("t_true"))
    rows = other.select("record_no", "pair_id").join(truth, "record_no")  # before there is a row per seed
    return predictors.stratified_predict(train, rows, list(range(N_SEEDS)), keep=["split", "y_true", "t_true"])


_AREA = "CASE WHEN count(*) FILTER (y_true) > 0 AND count(*) FILTER (NOT y_true) > 0 THEN 0.5::DOUBLE END"  # one score for all rows: every pair is a tie
_TYPE = {c: [f"count(*) FILTER (y_true AND {x})" for x in (f"t_true = '{c}' AND t_pred = '{c}'", f"t_pred = '{c}'", f"t_true = '{c}'")] for c in CONFLICT_TYPES}
_NINE = {m: B[m] for m in ("precision", "recall", "f1", "macro_f1", "accuracy")} | {
    "roc_auc": _AREA, "typology_macro_f1": "CASE WHEN count(*) FILTER (y_true) > 0 THEN (" + " + ".join(_ratio(f"2*{t}", f"{p}+{s}") for t, p, s in _TYPE.values()) + ") / 4 END",
    "typology_accuracy": f"CASE WHEN count(*) FILTER (y_true) > 0 THEN {_ratio('count(*) FILTER (y_true AND t_true = t_pred)', 'count(*) FILTER (y_true)')} END", "joint_accuracy": _ratio(f"count(*) FILTER ({_JOINT})", "count(*)")}


@query(f"""WITH {_RANDOM}, aligned AS (SELECT seed, split, coalesce(record_type = 'conflict', FALSE) AS y_true, CASE WHEN record_type = 'conflict' THEN conflict_type END AS t_true, y_pred, t_pred FROM rnd JOIN other ON record_no = ord),
s AS (SELECT seed, split, {', '.join(f'round({x}, 9) AS {m}' for m, x in _NINE.items())} FROM aligned GROUP BY seed, split), long AS ({' UNION ALL '.join(f"SELECT split, '{m}' AS metric, {m} AS value FROM s" for m in _NINE)})
SELECT split, metric, round(avg(value), 9) AS mean, round(coalesce(stddev_pop(value), 0.0), 9) AS std, round(min(value), 9) AS min, round(max(value), 9) AS max, count(value) AS n FROM long GROUP BY split, metric""")
def seed_sweep(spark, d):
    """All seeds at once: predictions, headline metrics per seed and split, summary over the seeds."""
    return predictors.summarise(predictors.sweep_metrics(_sweep(spark, d)), "value", ["split", "metric"])


@query()
def seed_intervals(spark, d):
    """Bootstrap intervals of every seed and split, 100 replicates each and 1000 for seed 42."""
    return statistics.sweep_intervals(_sweep(spark, d))


@query(f"WITH {_RANDOM}, said AS (SELECT split, CASE WHEN y_pred THEN coalesce(t_pred, 'untyped') ELSE 'non_conflict' END AS what FROM rnd JOIN other ON record_no = ord), c AS (SELECT split, what, count(*) AS n FROM said GROUP BY ALL) SELECT split, what AS label, n, round(n / sum(n) OVER (PARTITION BY split), 9) AS share FROM c")
def predicted_shares(spark, d):
    return predictors.predicted_shares(_sweep(spark, d), ["split"])


# -- agreement and resampling ------------------------------------------------------------------------------------------

def _pairs(spark, d):
    return statistics.aligned_labels(*V.annotators(spark, d))


_KAPPA = f"""inside AS (SELECT * FROM {{src}} WHERE a IN ({TYPES}) AND b IN ({TYPES})), k AS (SELECT {{by}} sum(w) AS n, coalesce(sum(w) FILTER (a = b), 0) AS agree, {' + '.join(f"coalesce(sum(w) FILTER (a = '{c}'), 0) * coalesce(sum(w) FILTER (b = '{c}'), 0)" for c in CONFLICT_TYPES)} AS chance FROM inside {{group}}),
kap AS (SELECT {{by}} n, CASE WHEN coalesce(n, 0) = 0 OR abs(1 - chance / (n * n)) < 1e-12 THEN 'nan'::DOUBLE ELSE (agree / n - chance / (n * n)) / (1 - chance / (n * n)) END AS kappa FROM k)"""
_BAND = "CASE WHEN kappa < 0 THEN 'poor' WHEN kappa < 0.21 THEN 'slight' WHEN kappa < 0.41 THEN 'fair' WHEN kappa < 0.6 THEN 'moderate' WHEN kappa < 0.81 THEN 'substantial' ELSE 'almost perfect' END"


@query(f"WITH {V.ANNOTATORS}, src AS (SELECT a, b, 1::BIGINT AS w FROM pairs), {_KAPPA.format(src='src', by='', group='')} SELECT n::BIGINT AS n, round(kappa, 9) AS kappa, {_BAND} AS band FROM kap")
def cohen_kappa(spark, d):
    return statistics.cohen_kappa(_pairs(spark, d))


@query(f"WITH {V.ANNOTATORS}, {_CLASSES} SELECT x.c AS a, y.c AS b, count(p.pair_id) AS n FROM classes x CROSS JOIN classes y LEFT JOIN pairs p ON p.a = x.c AND p.b = y.c GROUP BY ALL")
def kappa_confusion(spark, d):
    return statistics.kappa_confusion(_pairs(spark, d))


@query(f"WITH {V.ANNOTATORS} SELECT pair_id, a, b FROM pairs WHERE side = 'both' AND a IS DISTINCT FROM b")
def disagreements(spark, d):
    return _pairs(spark, d).where((F.col("side") == "both") & ~F.col("a").eqNullSafe(F.col("b"))).select("pair_id", "a", "b")


@query(f"WITH {V.ANNOTATORS} SELECT side, count(*) AS n, count(*) FILTER (a = b) AS agreed FROM pairs GROUP BY side")
def raw_agreement(spark, d):
    return _pairs(spark, d).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("agreed"))


def _draws(source: str, cell: list[str], seed: int = 42, n: int = REPLICATES) -> str:
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in cell)
    return f"""cells AS (SELECT *, sum(n) OVER (ORDER BY {order}) AS hi FROM (SELECT {', '.join(cell)}, count(*) AS n FROM {source} GROUP BY ALL)), total AS (SELECT count(*) AS n FROM {source}),
fours AS (SELECT rep, q, md5('{seed}|' || rep::VARCHAR || '|' || q::VARCHAR) AS h FROM range({n}) b(rep), (SELECT unnest(range(((SELECT n FROM total) + 3) // 4)) AS q)),
slots AS (SELECT rep, (('0x' || substr(h, 8 * k + 1, 8))::BIGINT * (SELECT n FROM total)) >> 32 AS i FROM fours, (SELECT unnest(range(4)) AS k) WHERE 4 * q + k < (SELECT n FROM total)),
drawn AS (SELECT rep, {', '.join(cell)}, count(*) AS w FROM slots JOIN cells ON i >= hi - n AND i < hi GROUP BY ALL)"""


W = _binary("w")
_TYPED = {c: {"t": f"coalesce(sum(w) FILTER (y_true AND t_true = '{c}' AND t_pred = '{c}'), 0)", "p": f"coalesce(sum(w) FILTER (y_true AND t_pred = '{c}'), 0)", "s": f"coalesce(sum(w) FILTER (y_true AND t_true = '{c}'), 0)"} for c in CONFLICT_TYPES}
_TYPO = "(" + " + ".join(_ratio(f"2*{x['t']}", f"{x['p']}+{x['s']}") for x in _TYPED.values()) + ") / 4"
_SEVEN = [W["precision"], W["recall"], W["f1"], W["macro_f1"], W["accuracy"], f"CASE WHEN sum(w) FILTER (y_true) > 0 THEN {_TYPO} ELSE 0.0 END", _ratio(f"coalesce(sum(w) FILTER ({_JOINT}), 0)", "sum(w)")]
_VALUES = "reps AS (SELECT rep, " + ", ".join(f"{x} AS m{i}" for i, x in enumerate(_SEVEN)) + " FROM drawn GROUP BY rep), long AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, m{i} AS value FROM reps" for i, m in enumerate(statistics.METRICS)) + ")"
_INTERVAL = "round(avg(value), 9) AS mean, round(quantile_cont(value, 0.025), 9) AS low, round(quantile_cont(value, 0.975), 9) AS high, count(*) AS n"


_PLAIN = f"""plain AS (SELECT y_true, y_pred, CASE WHEN t_true IS NULL OR t_true IN ({TYPES}) THEN t_true ELSE '?same' END AS t_true, CASE WHEN t_pred IS NULL OR t_pred IN ({TYPES}) THEN t_pred WHEN t_pred = t_true THEN '?same' ELSE '?other' END AS t_pred FROM aligned)"""


@query(f"WITH {V.aligned_sql()}, {_PLAIN}, {_draws('plain', statistics.CELL)}, {_VALUES} SELECT metric, {_INTERVAL} FROM long GROUP BY metric")
def bootstrap_intervals(spark, d):
    return statistics.bootstrap_intervals(V.aligned(spark, d), replicates=REPLICATES)


@query(f"WITH {V.ANNOTATORS}, ins AS (SELECT a, b FROM pairs WHERE a IN ({TYPES}) AND b IN ({TYPES})), {_draws('ins', ['a', 'b'])}, {_KAPPA.format(src='drawn', by='rep,', group='GROUP BY rep')}, vals AS (SELECT kappa AS value FROM kap WHERE NOT isnan(kappa)) SELECT {_INTERVAL} FROM vals")
def kappa_interval(spark, d):
    return statistics.kappa_interval(_pairs(spark, d), replicates=REPLICATES)


def _paired(spark, d):
    a = V.aligned(spark, d, "s1").select("ord", "y_true", F.col("y_pred").alias("y_a"))
    return a.join(V.aligned(spark, d, "s3").select("ord", F.col("y_pred").alias("y_b")), "ord").select("y_true", "y_a", "y_b")


def _f1_of(p: str, w: str) -> str:
    n = [f"coalesce(sum({w}) FILTER ({c}), 0)" for c in (f"y_true AND {p}", f"NOT y_true AND {p}", f"y_true AND NOT {p}")]
    return _ratio(f"2*{n[0]}", f"2*{n[0]}+{n[1]}+{n[2]}")


_ENDS = "round(quantile_cont(a, 0.025), 9) AS low_a, round(quantile_cont(a, 0.975), 9) AS high_a, round(quantile_cont(c, 0.025), 9) AS low_b, round(quantile_cont(c, 0.975), 9) AS high_b"
_PAIRED = f"""WITH {V.predictions_sql(['s1', 's3'])}, paired AS (SELECT y_true, coalesce(a.y_pred, FALSE) AS y_a, coalesce(b.y_pred, FALSE) AS y_b FROM gold LEFT JOIN last a ON a.pair_id = gold.pair_id AND a.system = 's1' LEFT JOIN last b ON b.pair_id = gold.pair_id AND b.system = 's3'),
{_draws('paired', ['y_true', 'y_a', 'y_b'])}, each AS (SELECT rep, {_f1_of('y_a', 'w')} AS a, {_f1_of('y_b', 'w')} AS c FROM drawn GROUP BY rep), diff AS (SELECT a, c, a - c AS d FROM each), seen AS (SELECT {_f1_of('y_a', '1')} AS fa, {_f1_of('y_b', '1')} AS fb, {_f1_of('y_a', '1')} - {_f1_of('y_b', '1')} AS observed FROM paired),
mid AS (SELECT CENTRE AS mid_d FROM diff, seen), out AS (SELECT round(avg(a), 9) AS f1_a, round(avg(c), 9) AS f1_b, round((SELECT fa FROM seen), 9) AS observed_a, round((SELECT fb FROM seen), 9) AS observed_b, {_ENDS}, round((SELECT observed FROM seen), 9) AS observed, round(avg(d), 9) AS mean_difference, round(quantile_cont(d, 0.025), 9) AS low, round(quantile_cont(d, 0.975), 9) AS high,
  round(avg((abs(d - (SELECT mid_d FROM mid)) >= abs((SELECT mid_d FROM mid)))::INT), 9) AS p_value, count(*) AS n FROM diff) SELECT * FROM out"""


@query(_PAIRED.replace("CENTRE", "avg(d)"))
def paired_bootstrap(spark, d):
    return statistics.paired_bootstrap(_paired(spark, d), replicates=REPLICATES).drop("p_text")


@query(_PAIRED.replace("CENTRE", "min(observed)"))
def paired_bootstrap_observed(spark, d):
    return statistics.paired_bootstrap(_paired(spark, d), replicates=REPLICATES, centre="observed").drop("p_text")


_DRAWS = {"a": ["s0", "s1"], "b": ["s2", "s3", "s4"]}


def _mean_f1(names: list[str], w: str) -> str:
    return "(" + " + ".join(_f1_of(f"y_{n}", w) for n in names) + f") / {len(names)}"


@query(f"""WITH {_LAST}, paired AS (SELECT y_true, {', '.join(f"coalesce(max(l.y_pred::INT) FILTER (l.system = '{s}'), 0) = 1 AS y_{s}" for s in SIX)} FROM gold LEFT JOIN last l USING (pair_id) GROUP BY gold.ord, y_true),
{_draws('paired', ['y_true'] + [f'y_{s}' for s in SIX])}, each AS (SELECT rep, {_mean_f1(_DRAWS['a'], 'w')} AS a, {_mean_f1(_DRAWS['b'], 'w')} AS c FROM drawn GROUP BY rep), diff AS (SELECT a, c, a - c AS d FROM each),
mid AS (SELECT {_mean_f1(_DRAWS['a'], '1')} AS fa, {_mean_f1(_DRAWS['b'], '1')} AS fb, {_mean_f1(_DRAWS['a'], '1')} - {_mean_f1(_DRAWS['b'], '1')} AS mid_d FROM paired) SELECT round(avg(a), 9) AS f1_a, round(avg(c), 9) AS f1_b, round((SELECT fa FROM mid), 9) AS observed_a, round((SELECT fb FROM mid), 9) AS observed_b, {_ENDS}, round((SELECT mid_d FROM mid), 9) AS observed, round(avg(d), 9) AS mean_difference,
 round(quantile_cont(d, 0.025), 9) AS low, round(quantile_cont(d, 0.975), 9) AS high, round(avg((abs(d - (SELECT mid_d FROM mid)) >= abs((SELECT mid_d FROM mid)))::INT), 9) AS p_value, count(*) AS n FROM diff""")
def paired_bootstrap_draws(spark, d):
    """Two systems with several draws each, compared by their mean F1."""
    last = alignment.last_predictions(V.predictions(spark, d, SIX), by=["system"])
    wide = last.groupBy("pair_id").agg(*(F.max(F.when(F.col("system") == s, F.col("y_pred"))).alias(f"y_{s}") for s in SIX))
    paired = V.gold(spark, d).join(wide, "pair_id", "left").select("y_true", *(F.coalesce(f"y_{s}", F.lit(False)).alias(f"y_{s}") for s in SIX))
    return statistics.paired_bootstrap(paired, a=[f"y_{s}" for s in _DRAWS["a"]], b=[f"y_{s}" for s in _DRAWS["b"]], replicates=REPLICATES, centre="observed").drop("p_text")


# -- dataset tooling ---------------------------------------------------------------------------------------------------

_SPLIT = """st AS (SELECT record_no, CASE WHEN record_type = 'conflict' THEN 'conflict::' || coalesce(nullif(conflict_type, ''), 'conflict_unknown') ELSE 'non_conflict' END AS stratum FROM labelled_pairs),
rk AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || record_no::VARCHAR), record_no) AS position, count(*) OVER (PARTITION BY stratum) AS n FROM st),
fl AS (SELECT *, floor(n * 0.7::DOUBLE)::BIGINT AS a, floor(n * 0.15::DOUBLE)::BIGINT AS b FROM rk), lf AS (SELECT *, n - a - 2 * b AS l FROM fl),
sp AS (SELECT record_no, stratum, CASE WHEN position <= a + (l > 0)::INT THEN 'train' WHEN position <= a + (l > 0)::INT + b + (l > 1)::INT THEN 'val' ELSE 'test' END AS split, position FROM lf)"""


@query(f"WITH {_SPLIT} SELECT * FROM sp")
def stratified_split(spark, d):
    return dataset.stratified_split(V.records(spark, d))


@query("SELECT split, count(*) AS n_records, count(DISTINCT pair_id) AS n_pairs, count(*) FILTER (record_type = 'conflict') AS conflict, count(*) FILTER (record_type = 'non_conflict') AS non_conflict, " + ", ".join(f"count(*) FILTER (record_type = 'conflict' AND conflict_type = '{c}') AS {c}" for c in CONFLICT_TYPES) + ", count(*) FILTER (record_type = 'conflict' AND conflict_type IS NULL) AS unknown FROM labelled_pairs GROUP BY split")
def split_summary(spark, d):
    return dataset.split_summary(V.records(spark, d))


@query("SELECT pair_id, count(DISTINCT split) AS n_splits, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM labelled_pairs WHERE pair_id IS NOT NULL GROUP BY pair_id HAVING n_splits > 1")
def leakage(spark, d):
    return dataset.leakage(V.records(spark, d))


@query("SELECT split, pair_id, count(*) AS n FROM labelled_pairs WHERE pair_id IS NOT NULL GROUP BY ALL HAVING n > 1")
def duplicate_ids(spark, d):
    return dataset.duplicate_ids(V.records(spark, d))


@query(f"""WITH c AS (SELECT record_no, unnest([CASE WHEN pair_id IS NULL THEN 'missing:pair_id' END, CASE WHEN regime_a IS NULL THEN 'missing:regime_a' END, CASE WHEN regime_b IS NULL THEN 'missing:regime_b' END,
 CASE WHEN record_type IS NULL OR record_type NOT IN ('conflict', 'non_conflict') THEN 'record_type' END, CASE WHEN conflict_type NOT IN ({TYPES}) THEN 'conflict_type' END, CASE WHEN severity NOT IN ('low', 'medium', 'high') THEN 'severity' END,
 CASE WHEN non_conflict_subtype NOT IN ({', '.join(repr(x) for x in NON_CONFLICT_SUBTYPES)}) THEN 'non_conflict_subtype' END, CASE WHEN review.decision NOT IN ('accept', 'revise', 'reject') THEN 'review.decision' END,
 CASE WHEN record_type = 'conflict' AND conflict_type IS NULL THEN 'conflict_without_type' END, CASE WHEN record_type = 'conflict' AND severity IS NULL THEN 'conflict_without_severity' END]) AS violation FROM labelled_pairs) SELECT * FROM c WHERE violation IS NOT NULL""")
def schema_violations(spark, d):
    return dataset.schema_violations(V.records(spark, d))


@query(f"""WITH m AS (SELECT *, list_filter([CASE WHEN pair_id IS NULL THEN 'pair_id' END, CASE WHEN record_type IS NULL THEN 'record_type' END, CASE WHEN regime_a IS NULL THEN 'regime_a' END, CASE WHEN regime_b IS NULL THEN 'regime_b' END], lambda x: x IS NOT NULL) AS gone FROM labelled_pairs),
p AS (SELECT record_no, unnest(CASE WHEN len(gone) > 0 THEN ['missing ' || array_to_string(gone, ', ')] WHEN record_type NOT IN ('conflict', 'non_conflict') THEN ['bad record_type'] ELSE [CASE WHEN record_type = 'conflict' AND coalesce(conflict_type NOT IN ({TYPES}), TRUE) THEN 'bad conflict_type' END,
 CASE WHEN record_type = 'conflict' AND coalesce(severity NOT IN ('low', 'medium', 'high'), TRUE) THEN 'bad severity' END, CASE WHEN coalesce(regime_a.regime_id, '') = '' THEN 'empty regime_a.regime_id' END, CASE WHEN coalesce(regime_b.regime_id, '') = '' THEN 'empty regime_b.regime_id' END] END) AS problem FROM m) SELECT * FROM p WHERE problem IS NOT NULL""")
def record_checks(spark, d):
    return dataset.record_checks(V.records(spark, d))


@query("WITH s AS (SELECT unnest([regime_a.regime_id, regime_b.regime_id]) AS regime_id FROM labelled_pairs) SELECT regime_id, count(*) AS n FROM s WHERE regime_id <> '' AND regime_id NOT IN (SELECT source_collection FROM inventory WHERE source_collection IS NOT NULL) GROUP BY regime_id")
def unknown_regimes(spark, d):
    return dataset.unknown_regimes(V.records(spark, d), table(spark, d, "inventory"))


@query("""WITH x AS (SELECT 'split' AS what, split AS value FROM labelled_pairs UNION ALL SELECT 'record_type', record_type FROM labelled_pairs UNION ALL SELECT 'conflict_type', conflict_type FROM labelled_pairs UNION ALL SELECT 'jurisdiction', regime_a.jurisdiction FROM labelled_pairs UNION ALL SELECT 'jurisdiction', regime_b.jurisdiction FROM labelled_pairs)
SELECT what, value, count(*) AS n FROM x WHERE value IS NOT NULL GROUP BY ALL""")
def release_summary(spark, d):
    return dataset.release_summary(V.records(spark, d))


@query("SELECT trim(license_tier) AS license_tier, count(*) AS n FROM inventory GROUP BY ALL")
def tier_counts(spark, d):
    return dataset.tier_counts(table(spark, d, "inventory"))


@query("""WITH p AS (SELECT sha256, document_title, unnest([CASE WHEN coalesce(lower(trim(license_tier)) NOT IN ('tier 1', 'tier 2', 'tier 3'), TRUE) THEN 'unknown tier ' || coalesce(license_tier, 'null') END, CASE WHEN coalesce(sha256, '') = '' THEN 'empty sha256' END,
 CASE WHEN sha256 <> '' AND NOT regexp_full_match(sha256, '[0-9a-f]{64}') THEN 'malformed sha256' END]) AS problem FROM inventory) SELECT * FROM p WHERE problem IS NOT NULL""")
def inventory_problems(spark, d):
    return dataset.inventory_problems(table(spark, d, "inventory"))


@query("""WITH i AS (SELECT DISTINCT sha256, lower(trim(license_tier)) AS tier FROM inventory WHERE sha256 IS NOT NULL), f AS (SELECT DISTINCT tier, i.sha256 FROM i JOIN extracted e ON e.doc_id = substr(i.sha256, 1, 16))
SELECT sha256, tier FROM i WHERE sha256 NOT IN (SELECT sha256 FROM f) AND tier IN (SELECT tier FROM f)""")
def missing_files(spark, d):
    """The extracted documents stand for the files."""
    inventory = table(spark, d, "inventory").where("sha256 is not null")
    files = inventory.select("sha256", F.lower(F.trim("license_tier")).alias("tier"), F.substring("sha256", 1, 16).alias("doc_id")).join(table(spark, d, "extracted").select("doc_id"), "doc_id", "left_semi")
    return dataset.missing_files(inventory, files.select("tier", "sha256").distinct())


@query(f"""WITH t3 AS (SELECT DISTINCT sha256 FROM inventory WHERE sha256 IS NOT NULL AND lower(trim(license_tier)) = 'tier 3'), man AS (SELECT DISTINCT sha256, CASE WHEN {V.h_sql('url', 'sha256')} % 7 = 0 THEN ' ' ELSE 'https://example.org/' || sha256 END AS url FROM inventory WHERE sha256 IS NOT NULL AND {V.h_sql('man', 'sha256')} % 5 <> 0)
SELECT t3.sha256, CASE WHEN man.sha256 IS NULL THEN 'no manifest row' ELSE 'no source_url' END AS problem FROM t3 LEFT JOIN man USING (sha256) WHERE man.sha256 IS NULL OR trim(url) = ''""")
def manifest_problems(spark, d):
    inventory = table(spark, d, "inventory")
    url = F.when(V.h("url", "sha256") % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lit("https://example.org/"), F.col("sha256")))
    manifest = inventory.where(F.col("sha256").isNotNull() & (V.h("man", "sha256") % 5 != 0)).select("sha256", url.alias("source_url"), F.lit(0).alias("ord"))
    return dataset.manifest_problems(inventory, manifest)


@query("SELECT issuing_body, extractor, count(*) AS n, grouping_id(issuing_body, extractor)::INT AS level FROM extracted GROUP BY ROLLUP (issuing_body, extractor)")
def status_rollup(spark, d):
    return dataset.status_rollup(table(spark, d, "extracted"), "issuing_body", "extractor")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def text_hashes(spark, d):
    return dataset.text_hashes(table(spark, d, "documents"))


_REGISTRY = [("Singapore", "SGMB-Notices", "clause", "clause"), ("Singapore", "SGMB-Guidelines", "clause", "paragraph"), ("Australia", "ASMC", "guide", "paragraph"), ("Australia", "AUStatutes", "act", "section"), ("EU", "EULex-Portal", "regulation", "article")]


@query(f"""WITH reg(jurisdiction, issuing_body, parser_id, citation_unit) AS (VALUES {', '.join(map(str, _REGISTRY))})
SELECT doc_id, jurisdiction, issuing_body, coalesce(parser_id, 'generic') AS parser_id, coalesce(citation_unit, 'section') AS citation_unit FROM extracted LEFT JOIN reg USING (jurisdiction, issuing_body)""")
def registry_lookup(spark, d):
    registry = spark.createDataFrame(_REGISTRY, "jurisdiction string, issuing_body string, parser_id string, citation_unit string")
    return dataset.registry_lookup(table(spark, d, "extracted").select("doc_id", "jurisdiction", "issuing_body"), registry)


@query(f"""WITH runs AS (SELECT DISTINCT sha256 AS key, md5(sha256 || ({V.h_sql('run', 'sha256')} % 2)::VARCHAR) AS fingerprint FROM inventory WHERE sha256 IS NOT NULL), idx AS (SELECT DISTINCT sha256 AS key, md5(sha256 || '0') AS known FROM inventory WHERE sha256 IS NOT NULL AND {V.h_sql('idx', 'sha256')} % 3 <> 0)
SELECT key, fingerprint, known, known IS NULL OR known = fingerprint AS consistent FROM runs LEFT JOIN idx USING (key)""")
def hash_consistency(spark, d):
    keys = table(spark, d, "inventory").where("sha256 is not null").select("sha256").distinct()
    runs = keys.select(F.col("sha256").alias("key"), F.md5(F.concat("sha256", (V.h("run", "sha256") % 2).cast("string"))).alias("fingerprint"))
    index = keys.where(V.h("idx", "sha256") % 3 != 0).select(F.col("sha256").alias("key"), F.md5(F.concat("sha256", F.lit("0"))).alias("fingerprint"))
    return dataset.hash_consistency(runs, index)


@query("SELECT chunk_no, jurisdiction, CASE WHEN jurisdiction LIKE 'INT-%' THEN 'International' ELSE jurisdiction END AS area, starts_with(source_path, '/') AS absolute_path FROM chunks WHERE lower(trim(issuing_body)) LIKE '%guide%'")
def source_filter(spark, d):
    area = F.when(F.col("jurisdiction").startswith("INT-"), "International").otherwise(F.col("jurisdiction"))
    rows = table(spark, d, "chunks").where(F.lower(F.trim("issuing_body")).contains("guide"))
    return rows.select("chunk_no", "jurisdiction", area.alias("area"), F.col("source_path").startswith("/").alias("absolute_path"))


# -- texts -------------------------------------------------------------------------------------------------------------

_PAGES = "pg AS (SELECT doc_id, extracted_at, unnest(pages) AS p, unnest(range(len(pages))) AS pos FROM extracted)"


@query(f"WITH {_PAGES} SELECT doc_id, count(*) AS n_pages, sum(coalesce(length(p.text), 0))::BIGINT AS chars FROM pg GROUP BY doc_id")
def page_totals(spark, d):
    return ingestion.pages_of(table(spark, d, "extracted")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


@query(rf"""WITH {_PAGES}, full_lines AS (SELECT doc_id, extracted_at, list_filter(list_transform(string_split(coalesce(p.text, ''), chr(10)), lambda x: regexp_replace(x, '^[\s\x0B\p{{Z}}\x1c-\x1f\x85]+|[\s\x0B\p{{Z}}\x1c-\x1f\x85]+$', '', 'g')), lambda x: x <> '') AS l FROM pg),
edges AS (SELECT doc_id, extracted_at, unnest(list_concat(l[1:3], l[greatest(len(l) - 2, 1):])) AS line FROM full_lines), cnt AS (SELECT doc_id, extracted_at, line, count(*) AS n FROM edges WHERE length(line) BETWEEN 3 AND 120 GROUP BY ALL),
sz AS (SELECT doc_id, extracted_at, greatest(2, floor(count(*) * 0.5)) AS least FROM pg GROUP BY ALL) SELECT doc_id, extracted_at::VARCHAR AS at, line, n FROM cnt JOIN sz USING (doc_id, extracted_at) WHERE n >= least""")
def boilerplate_lines(spark, d):
    rows = table(spark, d, "extracted").select(F.struct("doc_id", "extracted_at").alias("k"), "pages")
    found = ingestion.boilerplate_lines(ingestion.pages_of(rows, ["k"]), "k")
    stamp = F.concat(F.date_format("k.extracted_at", "yyyy-MM-dd HH:mm:ss"), F.regexp_replace(F.date_format("k.extracted_at", ".SSSSSS"), r"\.?0*$", ""), F.lit("+00"))
    return found.select("k.doc_id", stamp.alias("at"), "line", "n")


_SPACE = r"[\s\x0B\p{Z}\x85]"
def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_NUMBER_LINE = r"(?im)^S*(?:pageS+)?\p{Nd}{1,4}(?:S*/S*\p{Nd}{1,4}|S+ofS+\p{Nd}{1,4})?S*$".replace("S", _SPACE)
_TIGHT = _strip(r"regexp_replace(regexp_replace(regexp_replace(a, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '(?m)[\t\f\r \x0B\p{Z}\x85]+$', '', 'g')")
_CHECKS = rf"""{_PAGES}, ordered AS (SELECT doc_id, extracted_at, p.page AS page, coalesce(p.text, '') AS t, row_number() OVER (PARTITION BY doc_id, extracted_at ORDER BY md5(CASE WHEN p.page IS NULL THEN doc_id ELSE doc_id || '|' || p.page::VARCHAR END), pos) AS rn FROM pg),
rates AS (SELECT doc_id, extracted_at, count(*) AS k, count(*) FILTER (length(t) < 20) AS empty, count(*) FILTER ({{signs}}) AS signs, sum(len(regexp_extract_all(t, '[\x{{FFFD}}\x00-\x08\x0b\x0c\x0e-\x1f]'))) AS odd, sum(length(t)) AS chars FROM ordered WHERE rn <= 10 GROUP BY ALL),
c AS (SELECT e.doc_id, e.extractor, coalesce(k, 0) AS sampled, coalesce(list_sum(list_transform(pages, lambda p: length(coalesce(p.text, ''))))::DOUBLE / nullif(page_count, 0), 0.0) AS avg_chars, coalesce(empty, 0)::DOUBLE / greatest(1, coalesce(k, 0)) AS empty_rate, coalesce(signs, 0)::DOUBLE / greatest(1, coalesce(k, 0)) AS section_rate, coalesce(odd, 0)::DOUBLE / greatest(1, coalesce(chars, 0)) AS suspicious_rate
  FROM extracted e LEFT JOIN rates r ON e.doc_id IS NOT DISTINCT FROM r.doc_id AND e.extracted_at IS NOT DISTINCT FROM r.extracted_at),
v AS (SELECT *, list_filter([CASE WHEN coalesce(extractor, '') IN ('', 'failed') THEN 'extraction failed' END, CASE WHEN avg_chars < 100 THEN 'near-empty document' END, CASE WHEN empty_rate > 0.4 THEN round_even(empty_rate * 100, 0)::INT::VARCHAR || '% of sampled pages near-empty' END,
  CASE WHEN section_rate = 0 AND avg_chars > 200 THEN 'no section markers in sample' END, CASE WHEN suspicious_rate > 0.005 THEN 'high suspicious-char rate (OCR garble?)' END], lambda x: x IS NOT NULL) AS reasons FROM c),
verdicts AS (SELECT * EXCLUDE (reasons), array_to_string(reasons, '; ') AS reason, len(reasons) > 0 AND NOT (len(reasons) = 1 AND reasons[1] = 'no section markers in sample') AS needs_reextraction FROM v)"""


@query(rf"""WITH {_PAGES}, u AS (SELECT doc_id, extracted_at, pos, p.page AS page, coalesce(p.text, '') AS t FROM pg), full_lines AS (SELECT doc_id, extracted_at, list_filter(list_transform(string_split(t, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS l FROM u),
edges AS (SELECT doc_id, extracted_at, unnest(list_concat(l[1:3], l[greatest(len(l) - 2, 1):])) AS line FROM full_lines), cnt AS (SELECT doc_id, extracted_at, line, count(*) AS n FROM edges WHERE length(line) BETWEEN 3 AND 120 GROUP BY ALL),
sz AS (SELECT doc_id, extracted_at, greatest(2, floor(count(*) * 0.5)) AS least FROM pg GROUP BY ALL), drops AS (SELECT doc_id, extracted_at, list(line) AS gone FROM cnt JOIN sz USING (doc_id, extracted_at) WHERE n >= least GROUP BY ALL),
kept AS (SELECT doc_id, extracted_at, pos, page, array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT list_contains(coalesce(gone, []), {_strip('x')})), chr(10)) AS t FROM u LEFT JOIN drops USING (doc_id, extracted_at)),
plain AS (SELECT *, regexp_replace(t, '{_NUMBER_LINE}', '', 'g') AS a FROM kept), tight AS (SELECT *, {_TIGHT} AS b FROM plain)
SELECT doc_id, string_agg(chr(12) || '<PAGE ' || page::VARCHAR || '>' || chr(12) || chr(10) || b, chr(10) ORDER BY pos) AS text FROM tight WHERE page IS NOT NULL GROUP BY doc_id, extracted_at""")
def plain_text(spark, d):
    """Cleaning without compatibility normalisation, which SQL lacks; pages without a number are left out."""
    pages = ingestion.clean_pages(table(spark, d, "extracted").where("pages is not null"), normalise=False).where("page is not null")
    return ingestion.joined_text(pages, ["doc_id", "_row"]).select("doc_id", "text")


@query()
def clean_text(spark, d):
    pages = ingestion.clean_pages(table(spark, d, "extracted").where("pages is not null"))
    return ingestion.joined_text(pages, ["doc_id", "_row"]).select("doc_id", F.col("_row").alias("row_key"), "text")


@query(f"WITH {_PAGES}, r AS (SELECT doc_id, p.page AS page, p.text AS text, row_number() OVER (PARTITION BY doc_id ORDER BY md5(CASE WHEN p.page IS NULL THEN doc_id ELSE doc_id || '|' || p.page::VARCHAR END), pos, extracted_at) AS rn FROM pg) SELECT doc_id, page, length(text) AS chars FROM r WHERE rn <= 10")
def page_sample(spark, d):
    return ingestion.page_sample(table(spark, d, "extracted")).select("doc_id", "page", F.length("text").cast("long").alias("chars"))


_SIGNS = " OR ".join("regexp_matches(t, '" + p.replace("(?i)", "(?i)").replace("(?m)", "(?m)") + "')" for p in T.SECTION_SIGNS)


@query(rf"WITH {_PAGES}, x AS (SELECT doc_id, pos, p.page AS page, coalesce(p.text, '') AS t FROM pg) SELECT doc_id, page, length(t)::INT AS chars, ({_SIGNS}) AS has_section_sign, len(regexp_extract_all(t, '[\x{{FFFD}}\x00-\x08\x0b\x0c\x0e-\x1f]'))::INT AS suspicious FROM x")
def page_checks(spark, d):
    return ingestion.page_checks(ingestion.pages_of(table(spark, d, "extracted")))


@query(f"WITH {_CHECKS.replace('{signs}', _SIGNS)} SELECT * FROM verdicts")
def document_checks(spark, d):
    return ingestion.with_verdict(ingestion.document_checks(table(spark, d, "extracted")))


@query(f"WITH {_CHECKS.replace('{signs}', _SIGNS)} SELECT doc_id, extractor, printf('%.1f', round_even(avg_chars, 1)) AS avg_chars, printf('%.2f', round_even(empty_rate, 2)) AS empty_rate, printf('%.2f', round_even(section_rate, 2)) AS section_rate, printf('%.4f', round_even(suspicious_rate, 4)) AS suspicious_rate, needs_reextraction::INT AS needs_reextraction, reason FROM verdicts")
def quality_summary(spark, d):
    return ingestion.quality_summary(ingestion.document_checks(table(spark, d, "extracted")))


@query("SELECT coalesce(extractor, '') AS extractor, count(*) AS n_documents, sum(coalesce(len(pages), 0))::BIGINT AS n_pages FROM extracted GROUP BY ALL")
def extractor_breakdown(spark, d):
    return ingestion.extractor_breakdown(table(spark, d, "extracted"))


@query(rf"SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(list_sum(list_transform(list_filter(list_transform(string_split_regex(text, '\n{{2,}}'), lambda x: {_strip('x')}), lambda x: x <> ''), lambda p: len(regexp_extract_all(p, '[.!?][\s\x0B]+[A-Z(]')) + 1)), 0) END::INT AS n_sentences FROM documents")
def sentence_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sentence_count("text").alias("n_sentences"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(filename, '\.[^./]*$', ''), '[^A-Za-z0-9._-]+', '_', 'g') || '__' || doc_id AS stem, split_part(source_path, '/', 1) AS top FROM extracted")
def output_names(spark, d):
    return table(spark, d, "extracted").select("doc_id", F.concat(T.safe_name("filename"), F.lit("__"), F.col("doc_id")).alias("stem"), T.path_parts("source_path")[0].alias("top"))


@query()
def parse_blocks(spark, d):
    registry = spark.createDataFrame(_REGISTRY, "jurisdiction string, issuing_body string, parser_id string, citation_unit string")
    chunks = dataset.registry_lookup(table(spark, d, "chunks").select("chunk_no", "jurisdiction", "issuing_body", "text"), registry)
    return structure.parse_blocks(chunks, id_col="chunk_no", parser_col="parser_id")


@query()
def chunk_documents(spark, d):
    return structure.chunk_documents(table(spark, d, "documents"))


@query()
def chunk_statistics(spark, d):
    return structure.chunk_statistics(structure.chunk_documents(table(spark, d, "documents")))


# -- prompts and replies -----------------------------------------------------------------------------------------------

def _passage_sql(side: str) -> str:
    return rf"array_to_string(list_transform(range(1, len(coalesce({side}, [])) + 1), lambda i: '[Chunk ' || i::VARCHAR || CASE WHEN {side}[i].page <> 0 THEN ', p.' || {side}[i].page::VARCHAR ELSE '' END || ']' || chr(10) || regexp_replace(coalesce({side}[i].passage, ''), '^[\s\x0B\p{{Z}}\x1c-\x1f\x85]+|[\s\x0B\p{{Z}}\x1c-\x1f\x85]+$', '', 'g')), chr(10) || chr(10))"


@query(f"SELECT record_no, {_passage_sql('evidence_a')} AS passage_a, {_passage_sql('evidence_b')} AS passage_b FROM labelled_pairs")
def passages(spark, d):
    return V.records(spark, d).select("record_no", replies.passage("evidence_a").alias("passage_a"), replies.passage("evidence_b").alias("passage_b"))


_TEMPLATE = "A ({jurisdiction_a}, {regime_a}):\n{passage_a}\nB ({jurisdiction_b}, {regime_b}):\n{passage_b}\nAnswer as JSON."


@query(f"SELECT record_no, 'A (' || coalesce(regime_a.jurisdiction, '?') || ', ' || coalesce(regime_a.regime_id, '?') || '):' || chr(10) || {_passage_sql('evidence_a')} || chr(10) || 'B (' || coalesce(regime_b.jurisdiction, '?') || ', ' || coalesce(regime_b.regime_id, '?') || '):' || chr(10) || {_passage_sql('evidence_b')} || chr(10) || 'Answer as JSON.' AS prompt FROM labelled_pairs")
def prompts(spark, d):
    return V.records(spark, d).select("record_no", replies.render(_TEMPLATE, replies.pair_fields()).alias("prompt"))


@query(f"WITH {V.ATTEMPTS} SELECT pair_id, attempt_n, success, present AS conflict_present, ctype AS conflict_type, reason AS failure_reason FROM parsed")
def parse_replies(spark, d):
    return replies.parse_replies(V.attempts(spark, d)).select("pair_id", "attempt_n", "success", "conflict_present", "conflict_type", "failure_reason")


_OUTCOMES = V.ATTEMPTS + """, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY attempt_n) AS rn FROM parsed WHERE success) WHERE rn = 1),
agg AS (SELECT pair_id, count(*) AS n_attempts, round(sum(latency), 6) AS total_latency, arg_max(reason, attempt_n) FILTER (reason IS NOT NULL) AS why FROM parsed GROUP BY pair_id),
outcomes AS (SELECT pair_id, n_attempts, attempt_n AS n_retries, temperature AS succeeded_at, coalesce(present, FALSE) AS y_pred, ctype AS t_pred, total_latency, CASE WHEN attempt_n IS NULL THEN why END AS failure_reason FROM agg LEFT JOIN best USING (pair_id))"""


def _outcomes(spark, d):
    return replies.first_success(replies.parse_replies(V.attempts(spark, d)), ["pair_id"])


@query(f"WITH {_OUTCOMES} SELECT * FROM outcomes")
def first_success(spark, d):
    return _outcomes(spark, d)


@query(f"WITH {_OUTCOMES} SELECT count(*) AS n, round(count(*) FILTER (n_retries IS NULL) / count(*), 9) AS failure_rate, " + ", ".join(f"count(*) FILTER (n_retries = {k}) AS retries_{k}" for k in range(3)) + ", count(*) FILTER (succeeded_at = 0.0) AS at_0_0, count(*) FILTER (succeeded_at = 0.3) AS at_0_3, count(*) FILTER (succeeded_at = 0.7) AS at_0_7, count(*) FILTER (n_retries IS NULL) AS at_none FROM outcomes")
def retry_summary(spark, d):
    return replies.retry_summary(_outcomes(spark, d))


# -- training ----------------------------------------------------------------------------------------------------------

@query()
def joint_budget(spark, d):
    return training.joint_budget(V.records(spark, d), structure.count_words)


@query()
def truncation_statistics(spark, d):
    return training.truncation_statistics(training.joint_budget(V.records(spark, d), structure.count_words))


_EPOCHS = f"epochs AS (SELECT run::INT AS run, epoch::INT AS epoch, {V.h_sql('val', 'run', 'epoch')} % 100 / 100.0::DOUBLE AS score FROM range(40) r(run), range(1, 13) e(epoch))"


@query(f"""WITH {_EPOCHS}, b AS (SELECT *, max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM epochs), u AS (SELECT *, before IS NULL OR score > before AS up FROM b),
l AS (SELECT *, max(CASE WHEN up THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS lastup FROM u), s AS (SELECT *, min(CASE WHEN epoch - lastup >= 3 THEN epoch END) OVER (PARTITION BY run) AS stopped FROM l)
SELECT run, max(CASE WHEN up THEN epoch END) AS best_epoch, max(score) AS best_score, any_value(stopped) AS stopped_at FROM s WHERE stopped IS NULL OR epoch <= stopped GROUP BY run""")
def early_stopping(spark, d):
    """Forty runs of twelve epochs with scores by hash; needs no table."""
    runs = spark.range(40).select(F.col("id").cast("int").alias("run"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("epoch"))
    return training.early_stop(runs.withColumn("score", V.h("val", "run", "epoch") % 100 / F.lit(100.0)), ["run"])


# -- sinks and streams -------------------------------------------------------------------------------------------------

@query("""SELECT sha256, 'data/corpus/' || CASE lower(trim(license_tier)) WHEN 'tier 1' THEN 'tier1_redistributable' WHEN 'tier 2' THEN 'tier2_attribution' WHEN 'tier 3' THEN 'tier3_fetch' ELSE 'other' END || coalesce('/' || source_collection, '') || coalesce('/' || filename, '') AS path FROM inventory""")
def release_paths(spark, d):
    return table(spark, d, "inventory").select("sha256", sinks.release_path("license_tier", "source_collection", "filename").alias("path"))


@query(f"SELECT chunk_no, chunk_id FROM chunks ANTI JOIN (SELECT DISTINCT doc_id FROM extracted UNION SELECT doc_id FROM chunks WHERE {V.h_sql('done', 'doc_id')} % 2 = 0) USING (doc_id)")
def not_yet_written(spark, d):
    """Chunks of documents that no earlier output holds."""
    chunks = table(spark, d, "chunks")
    written = table(spark, d, "extracted").select("doc_id").unionByName(chunks.where(V.h("done", "doc_id") % 2 == 0).select("doc_id"))
    return sinks.not_yet_written(chunks.select("chunk_no", "chunk_id", "doc_id"), written, ["doc_id"]).select("chunk_no", "chunk_id")


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    """Beyond the reference: windowed counts, the same operator for tables and streams."""
    counts = incremental.windowed_counts(table(spark, d, "events"), keys=["event_type"])
    return counts.withColumn("total", F.round("total", 4))


@query("SELECT (row_number() OVER (ORDER BY pair_id) - 1)::INT AS place, pair_id, record_no FROM (SELECT pair_id, max(record_no) AS record_no FROM labelled_pairs WHERE pair_id IS NOT NULL GROUP BY pair_id ORDER BY pair_id LIMIT 20)")
def smoke_subset(spark, d):
    """The first twenty pair_ids, asked for by list."""
    rows = V.records(spark, d).where("pair_id is not null")
    wanted = [r[0] for r in rows.select("pair_id").distinct().orderBy("pair_id").limit(20).collect()]
    return dataset.ordered_subset(rows.select("pair_id", "record_no"), "pair_id", wanted)


@query("SELECT record_no, split FROM labelled_pairs WHERE split = 'train' ORDER BY md5('42|' || record_no::VARCHAR), record_no LIMIT 50")
def hash_sample(spark, d):
    """A sampling operator: fifty training records."""
    return dataset.hash_sample(V.records(spark, d).where("split = 'train'").select("record_no", "split"), 50, id_col="record_no")


@query("""SELECT * FROM (SELECT DISTINCT source_path AS path, unnest([CASE WHEN source_path LIKE '/%' THEN 'absolute path' END, CASE WHEN list_contains(string_split(source_path, '/'), 'ATRO') OR len(list_filter(string_split(source_path, '/'), lambda p: starts_with(p, 'SGMB-'))) > 0 THEN 'withheld source' END]) AS problem FROM chunks)
WHERE problem IS NOT NULL""")
def path_problems(spark, d):
    return dataset.path_problems(table(spark, d, "chunks"), "source_path", ["ATRO", "SGMB-"])


_SAID = "CASE WHEN l.y_pred THEN coalesce(l.t_pred, 'conflict') ELSE 'non_conflict' END"


@query(f"WITH {_LAST} SELECT gold.ord, pair_id, CASE WHEN y_true THEN coalesce(t_true, 'conflict') ELSE 'non_conflict' END AS truth, " + ", ".join(f"coalesce(max({_SAID}) FILTER (l.system = '{s}'), '?') AS {s}" for s in SIX) + " FROM gold LEFT JOIN last l USING (pair_id) GROUP BY gold.ord, pair_id, truth")
def side_by_side(spark, d):
    return dataset.side_by_side(V.gold(spark, d), alignment.last_predictions(V.predictions(spark, d, SIX), by=["system"]), SIX)


@query("SELECT record_no, pair_id, regime_a.jurisdiction AS a, regime_b.jurisdiction AS b, substr(rationale, 1, 250) AS rationale, array_to_string(list_transform(list_concat(coalesce(evidence_a, []), coalesce(evidence_b, [])), lambda x: substr(x.passage, 1, 180)), chr(10)) AS passages FROM labelled_pairs")
def record_samples(spark, d):
    return dataset.record_samples(V.records(spark, d))


@query(r"WITH t AS (SELECT sha256, coalesce(nullif(trim(document_title), ''), 'untitled') AS t FROM inventory), n AS (SELECT sha256, CASE WHEN regexp_matches(lower(t), '\.(pdf|html|htm)$') THEN t ELSE t || '.pdf' END AS filename FROM t) SELECT sha256, filename, coalesce(substr(sha256, 1, 8) || '/', '') || filename AS target FROM n")
def fetch_targets(spark, d):
    return dataset.fetch_targets(table(spark, d, "inventory"))


@query(f"WITH {_LAST}, n AS (SELECT system, count(*) AS n, count(*) FILTER (y_pred) AS k FROM last GROUP BY system) SELECT system, substr(sha256(system || '|' || n::VARCHAR || '|' || k::VARCHAR), 1, 16) AS fingerprint FROM n")
def model_fingerprints(spark, d):
    return dataset.model_fingerprints(alignment.last_predictions(V.predictions(spark, d, SIX), by=["system"]))


@query()
def encoder_examples(spark, d):
    return training.encoder_examples(V.records(spark, d), lambda text: [3 + len(w) for w in text.split()])


@query("SELECT q.vec_id AS query_id, r.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS cosine FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0 AND list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) >= 0.25")
def near_vectors(spark, d):
    """Queries are the vectors whose id is divisible by 50, searched against all; the test vectors are far apart, hence 0.25."""
    rows = table(spark, d, "embeddings")
    return vectors.near_vectors(rows, rows.where(F.col("vec_id") % 50 == 0), least=0.25).withColumn("cosine", F.round("cosine", 6))


from docloom.plans import more_queries  # noqa: E402,F401 - registers the rest
