"""Exact quantiles and concentration by narrowing, against brute force on small inputs."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from assay.functions.orderstats import quantile_row
from assay.operators.stats import cumulative_share, pareto

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.9, 1.0]


def quantiles(frame, values, limit):
    df = frame("v double", [(None if v is None else float(v),) for v in values])
    row = quantile_row(df, {f"p{i}": ("v", p) for i, p in enumerate(PROBS)}, limit=limit).first()
    return list(row)


def samples():
    rng = np.random.default_rng(7)
    return {
        "uniform": rng.uniform(-5, 5, 3000),
        "heavy_tail": np.exp(rng.normal(0, 4, 3000)),
        "one_value_holds_a_third": np.concatenate([np.full(1000, 2.5), rng.normal(2.5, 1, 2000)]),
        "two_values": np.repeat([0.0, 1.0], 1500),
        "all_equal": np.full(2000, 3.25),
        "integers": rng.integers(0, 40, 3000).astype(float),
    }


@pytest.mark.parametrize("name", samples())
def test_narrowing_equals_sorting(frame, name):
    values = samples()[name]
    want = np.quantile(values, PROBS)
    assert np.allclose(quantiles(frame, values, limit=40), want, rtol=1e-12)


def test_small_path_and_nulls(frame):
    values = [3.0, None, 1.0, 2.0, None]
    assert np.allclose(quantiles(frame, values, limit=100), np.quantile([1, 2, 3], PROBS))
    assert np.allclose(quantiles(frame, values, limit=1), np.quantile([1, 2, 3], PROBS))


def test_empty_column_gives_null(frame):
    df = frame("v double, w double", [(None, float(i)) for i in range(100)])
    row = quantile_row(df, {"a": ("v", 0.5), "b": ("w", 0.5)}, limit=10).first()
    assert row["a"] is None and row["b"] == 49.5


def test_extra_aggregates_ride_along(frame):
    from pyspark.sql import functions as F
    df = frame("v double", [(float(i),) for i in range(101)])
    for limit in (10, 1000):
        row = quantile_row(df, {"m": ("v", 0.5)}, limit, also={"s": F.sum("v")}).first()
        assert tuple(row) == (50.0, 5050.0)


def brute_pareto(values):
    ordered = np.sort(values)[::-1]
    total, cumulative = ordered.sum(), np.cumsum(ordered)
    top = ordered[: max(1, int(len(ordered) * 0.2))].sum()
    return top / total * 100, int((cumulative <= total * 0.8).sum()) + 1


@pytest.mark.parametrize("parts", [1, 40, None])
@pytest.mark.parametrize("seed", [1, 2])
def test_pareto_equals_sorting(frame, parts, seed):
    """One value in half of all rows for the second seed."""
    rng = np.random.default_rng(seed)
    values = np.concatenate([rng.integers(0, 60, 1500), rng.integers(500, 3000, 300)]).astype(float)
    values[:200] = 0.0
    values[900 * (2 - seed) + 200:1100] = 33.0
    row = pareto(frame("v double", [(float(v),) for v in values]), "v", min_pct=0, parts=parts).first()
    share, rows = brute_pareto(values)
    assert row["top_20_pct"] == pytest.approx(share, rel=1e-12)
    assert row["n_for_80"] == rows and row["n"] == len(values)


@pytest.mark.parametrize("parts", [30, None])
def test_curve_equals_sorting(frame, parts):
    values = np.random.default_rng(3).exponential(10, 997)
    ordered = np.sort(values)[::-1]
    rows = cumulative_share(frame("v double", [(float(v),) for v in values]), "v", parts).collect()
    step = len(values) // 20
    ranks = sorted({*range(1, len(values) + 1, step), len(values)})
    got = sorted((r["pct_rows"], r["pct_value"]) for r in rows)
    want = [(100 * r / len(values), ordered[:r].sum() / ordered.sum() * 100) for r in ranks]
    assert np.allclose(got, want, rtol=1e-9)


def test_curve_of_few_rows_ends_at_all_of_them(frame):
    rows = cumulative_share(frame("v double", [(float(i),) for i in range(1, 40)]), "v").collect()
    assert len(rows) == 39 and max(rows)[:] == (100.0, 100.0)


def test_many_equal_and_far_values_narrow(frame):
    values = [1e300, -1e300, *[float(i % 7) for i in range(300)], *[1e-9 * i for i in range(400)]]
    assert np.allclose(quantiles(frame, values, limit=3), np.quantile(values, PROBS))


def test_pareto_gates(frame):
    def run(values):
        return pareto(frame("v double", [(float(v),) for v in values]), "v").count()

    assert run([1] * 19) == 0                       # too few values
    assert run([-1] + [100] * 30) == 0              # a negative value
    assert run([0] * 30) == 0                       # nothing to share
    assert run([5] * 30) == 0                       # evenly spread
    assert run([1000] + [1] * 30) == 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6).map(lambda x: round(x, 3)), min_size=1, max_size=60))
def test_any_list(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = quantile_row(df, {"q": ("v", 0.3), "r": ("v", 0.8)}, limit=5).first()
    assert np.allclose(list(row), np.quantile(values, [0.3, 0.8]), rtol=1e-9, atol=1e-9)
