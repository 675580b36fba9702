"""The sweep over seeds: its size, and its intervals against plain resampling."""

import pytest
from conftest import DATA, same_rows

from docloom.operators import predictors, statistics
from docloom.plans import queries as core


def test_sweep_is_whole(spark):
    rows = core.QUERIES["seed_sweep"](spark, DATA).collect()
    splits = {r["split"] for r in rows}
    assert "test" in splits and {(r["split"], r["metric"]) for r in rows} == {(s, m) for s in splits for m in predictors.HEADLINE}
    assert {r["n"] for r in rows if r["metric"] == "f1"} == {100}
    assert core.QUERIES["stratified_predict"](spark, DATA).select("seed").distinct().count() == 100


def test_shares_are_over_all_seeds(spark):
    from pyspark.sql import functions as F

    other = core._train(spark, DATA)[1].groupBy("split").count()
    got = core.QUERIES["predicted_shares"](spark, DATA).groupBy("split").agg(F.sum("n").alias("n"), F.sum("share").alias("share"))
    assert {(r["split"], r["n"], round(r["share"], 6)) for r in got.collect()} == {(r["split"], 100 * r["count"], 1.0) for r in other.collect()}


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_no_join_has_a_row_per_seed(spark, threshold):
    """Else a side that is estimated small is broadcast with a hundred times its rows."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        plan = core._sweep(spark, DATA)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    seeds, join = (next(i for i, x in enumerate(plan) if what in x) for what in ("Generate explode", "Join"))
    assert seeds < join and not any("Generate" in x for x in plan[join:])


@pytest.mark.parametrize("name", ["seed_sweep", "predicted_shares"])
def test_sweep_of_repeated_and_missing_numbers(spark, tmp_path, name):
    """Repeated record numbers multiply and missing ones drop out as in the SQL."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * FROM '{DATA}/labelled_pairs.parquet' UNION ALL SELECT * REPLACE (CASE WHEN record_no % 3 = 0 THEN NULL ELSE record_no END AS record_no, CASE WHEN record_no % 2 = 0 THEN 'test' ELSE split END AS split, 'conflict' AS record_type)
        FROM '{DATA}/labelled_pairs.parquet' WHERE split <> 'train' AND record_no % 5 < 3) TO '{tmp_path}/labelled_pairs.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW labelled_pairs AS SELECT * FROM '{tmp_path}/labelled_pairs.parquet'")
    same_rows(core.QUERIES[name](spark, str(tmp_path)), con, core.SQL[name])


def test_intervals_of_a_sweep_are_those_of_each_seed(spark):
    types = ["structural_unresolved", "recurring_friction"]
    data = [(s, split, y, (i * s + i // 2) % 3 > 0, types[i % 2] if y else None, types[(i + s) % 2] if (i * s + i // 2) % 3 > 0 else None) for s in (3, 42) for split in ("test", "gold_iaa") for i, y in enumerate([True, False, True, True, False] * 4)]
    df = spark.createDataFrame(data, "seed int, split string, y_true boolean, y_pred boolean, t_true string, t_pred string")
    got = {(r["seed"], r["split"], r["metric"]): r for r in statistics.sweep_intervals(df, replicates=30, full=70).collect()}
    assert len(got) == 2 * 2 * 7
    for seed, n in ((3, 30), (42, 70)):
        for r in statistics.bootstrap_intervals(df.where(f"seed = {seed} and split = 'test'"), replicates=n).collect():
            own = got[seed, "test", r["metric"]]
            assert own["n"] == r["n"] == n and all(own[k] == pytest.approx(r[k]) for k in ("mean", "low", "high"))
