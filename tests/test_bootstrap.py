"""Resampling queries: as many replicates as the reference, and the draws against plain Python."""

import hashlib

import numpy as np
import pytest
from conftest import DATA

from docloom.operators import statistics
from docloom.plans import queries as core


@pytest.mark.parametrize("name", ["bootstrap_intervals", "paired_bootstrap", "paired_bootstrap_observed", "paired_bootstrap_draws"])
def test_a_thousand_replicates(spark, name):
    assert {r["n"] for r in core.QUERIES[name](spark, DATA).collect()} == {1000}


def test_a_thousand_replicates_of_kappa(spark):
    got = core.QUERIES["kappa_interval"](spark, DATA).first()["n"]  # replicates without a kappa are dropped
    assert 900 < got <= 1000


def drawn(n: int, replicates: int, seed: int = 42) -> list[list[int]]:
    return [[int(hashlib.md5(f"{seed}|{b}|{j // 4}".encode()).hexdigest()[8 * (j % 4) : 8 * (j % 4) + 8], 16) * n >> 32 for j in range(n)] for b in range(replicates)]


def f1(rows: list[tuple[bool, bool]]) -> float:
    tp, wrong = sum(y and p for y, p in rows), sum(y != p for y, p in rows)
    return 2 * tp / (2 * tp + wrong) if tp + wrong else 0.0


def test_paired_bootstrap_against_plain_python(spark):
    rows = sorted((i % 3 == 0, i % 4 < 2, i % 5 < 2) for i in range(40))
    got = statistics.paired_bootstrap(spark.createDataFrame(rows, "y_true boolean, y_a boolean, y_b boolean")).first()
    picks = [[rows[i] for i in d] for d in drawn(40, 1000)]
    a, b = (np.array([f1([(r[0], r[k]) for r in p]) for p in picks]) for k in (1, 2))
    assert got["n"] == 1000
    assert (got["f1_a"], got["f1_b"]) == (pytest.approx(a.mean(), abs=1e-8), pytest.approx(b.mean(), abs=1e-8))
    assert (got["low"], got["high"]) == tuple(pytest.approx(x, abs=1e-8) for x in np.quantile(a - b, [0.025, 0.975]))
    assert (got["observed_a"], got["observed_b"]) == tuple(pytest.approx(f1([(r[0], r[k]) for r in rows]), abs=1e-8) for k in (1, 2))
    for name, x in (("a", a), ("b", b)):
        assert (got[f"low_{name}"], got[f"high_{name}"]) == tuple(pytest.approx(q, abs=1e-8) for q in np.quantile(x, [0.025, 0.975]))


@pytest.mark.parametrize("n", [999_990, 1_000_010])
def test_one_way_to_draw_on_either_side_of_a_million(spark, n):
    """Same draws as plain Python at any size, and cut into blocks anyhow."""
    rows = spark.createDataFrame([(True, n // 3), (False, n - n // 3)], "y boolean, n long")
    first = sum(int(hashlib.md5(f"42|1|{q}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) * n >> 32 >= n - n // 3 for q in range(-(-n // 4)) for k in range(4) if 4 * q + k < n)
    for slots in (1 << 20, 1 << 17):
        got = statistics.resample(rows, ["y"], order=["y"], replicates=2, block_slots=slots).groupBy("b", "y").sum("w").collect()
        assert {(r[0], r[1]): r[2] for r in got}[1, True] == first
        assert sum(r[2] for r in got) == 2 * n


def test_types_outside_the_vocabulary_make_few_cells(spark):
    rows = [(True, True, f"odd{i}", f"odd{i - i % 2}") for i in range(500)] + [(True, True, "recurring_friction", f"odd{i}") for i in range(500)] + [(False, True, None, "recurring_friction"), (True, False, None, None)]
    df = spark.createDataFrame(rows, "y_true boolean, y_pred boolean, t_true string, t_pred string")
    assert statistics.plain_types(df).distinct().count() == 5
    got = {r["metric"]: r["mean"] for r in statistics.bootstrap_intervals(df, replicates=200).collect()}
    assert got["joint_accuracy"] == pytest.approx(250 / 1002, abs=0.01)
