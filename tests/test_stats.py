import numpy as np
import pytest

from assay.functions.pvalues import incomplete_beta, pearson_p
from assay.operators import stats as st
from assay.operators import timeseries as t


def test_correlation_with_gaps_and_constants(frame):
    x = [1.0, 2.0, None, 4.0, 5.0, 7.0, 8.0]
    y = [2.0, None, 1.0, 4.0, 4.5, 9.0, 7.0]
    df = frame("x double, y double, k double", [(a, b, 3.0) for a, b in zip(x, y)])
    rows = {(r["a"], r["b"]): r for r in st.correlation_matrix(df, ["x", "y", "k"]).collect()}
    pairs = np.array([(a, b) for a, b in zip(x, y) if a is not None and b is not None])
    assert rows[("x", "y")]["r"] == pytest.approx(np.corrcoef(pairs.T)[0, 1])
    assert rows[("x", "y")]["n"] == 5
    assert rows[("x", "k")]["r"] is None
    assert [r["b"] for r in st.correlation_pairs(df, ["x", "y", "k"]).collect()] == ["y"]


def test_p_values():
    # closed forms: with 2 degrees of freedom I_x(1, 1/2) = 1 - sqrt(1 - x); with n = 4, p = 1 - |r|
    assert incomplete_beta(1.0, 0.5, 0.36) == pytest.approx(1 - 0.8)
    for r in (0.1, -0.5, 0.9):
        assert pearson_p(r, 4) == pytest.approx(1 - abs(r))
    assert pearson_p(1.0, 10) == 0.0 and pearson_p(None, 10) is None
    assert pearson_p(0.0, 50) == pytest.approx(1.0)
    assert pearson_p(0.632, 10) == pytest.approx(0.05, abs=2e-3)  # tabulated 5 % point


def test_targeted_correlation_needs_five_pairs(frame):
    rows = [(float(i), float(i * i)) for i in range(4)]
    assert st.correlation(frame("a double, b double", rows), "a", "b").count() == 0
    row = st.correlation(frame("a double, b double", rows + [(9.0, 70.0)]), "a", "b").first()
    assert row["strength"] == "very strong" and row["significant"]


def test_shape_matches_textbook_formula(frame):
    values = np.random.default_rng(0).exponential(2, 50)
    row = st.shape_stats(frame("v double", [(float(v),) for v in values]), ["v"]).first()
    n, d = len(values), values - values.mean()
    m2, m3, m4 = (np.mean(d ** k) for k in (2, 3, 4))
    g1, g2 = m3 / m2 ** 1.5, m4 / m2 ** 2 - 3
    assert row["skewness"] == pytest.approx(np.sqrt(n * (n - 1)) / (n - 2) * g1)
    assert row["kurtosis"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    few = frame("v double", [(float(v),) for v in values[:9]])
    assert st.shape_stats(few, ["v"], min_skew=0).count() == 0


def test_influence_of_a_category(frame):
    df = frame("y double, c string, wide string", [(float(i % 2) * 4 + i / 100, "ab"[i % 2], f"w{i}")
                                                   for i in range(40)])
    both = st.factor_influence(df, "y", ["y"], ["c", "wide"]).collect()
    assert {r["feature"]: r["n_groups"] for r in both} == {"c": 2, "wide": 40}
    rows = st.factor_influence(df, "y", ["y"], ["c", "wide"], max_groups=30).collect()
    assert [r["feature"] for r in rows] == ["c"]
    assert rows[0]["impact"] == 1.0 and (rows[0]["best_group"], rows[0]["worst_group"]) == ("b", "a")


def months(frame, values):
    rows = [(f"{2023 + i // 12}-{i % 12 + 1:02d}-15", float(v)) for i, v in enumerate(values)]
    return frame("d string, v double", rows).selectExpr("cast(d as timestamp_ntz) d", "v")


def test_straight_line_trend_and_forecast(frame):
    df = months(frame, [100 + 10 * i for i in range(14)])
    row = t.trend(df, "d", "v").first()
    assert row["slope"] == pytest.approx(10) and row["r_squared"] == pytest.approx(1)
    assert (row["direction"], row["peak_period"], row["n_months"]) == ("upward", "2024-02", 14)
    ahead = t.linear_forecast(df, "d", "v").filter("type = 'forecast'").orderBy("period").collect()
    assert [r["period"] for r in ahead] == ["2024-03", "2024-04", "2024-05"]
    assert np.allclose([r["value"] for r in ahead], [240, 250, 260])
    change = t.forecast_change(t.linear_forecast(df, "d", "v")).first()
    assert change["direction"] == "increase" and change["change_pct"] == pytest.approx(1000 / 230)


def test_trend_needs_five_months_and_survives_a_constant(frame):
    assert t.trend(months(frame, [1, 2, 3, 4]), "d", "v").count() == 0
    row = t.trend(months(frame, [5] * 6), "d", "v").first()
    assert (row["slope"], row["r_squared"], row["direction"]) == (0.0, 0.0, "downward")


def test_growth_after_a_zero_month_is_unknown(frame):
    rows = t.period_growth(months(frame, [10, 20, 0, 5, 6]), "d", "v").collect()
    assert [r["growth_pct"] for r in rows] == [None, 100.0, -100.0, None, pytest.approx(20)]
    assert [r["is_peak"] for r in rows] == [False, True, False, False, False]


def test_spike(frame):
    values = [100 * 1.01 ** i for i in range(14)]
    values[-1] *= 4
    spikes = t.growth_spikes(months(frame, values), "d", "v").collect()
    assert [r["period"] for r in spikes] == ["2024-02"]


def test_scatter_counts_every_pair(frame):
    df = frame("a double, b double", [(float(i), float(i % 5)) for i in range(100)] + [(None, 1.0)])
    rows = st.scatter(df, "a", "b", bins=10).collect()
    assert sum(r["n"] for r in rows) == 100 and len(rows) == 50
    assert min(r["x"] for r in rows) > 0 and max(r["x"] for r in rows) < 99
    assert [tuple(r) for r in st.scatter(frame("a double, b double", [(2.0, 3.0)] * 4), "a", "b").collect()] == [(2.0, 3.0, 4)]


def test_many_columns_in_one_scan_of_block_sums(spark, frame):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 40)) + rng.normal(size=(300, 40)) + 1e6
    base[rng.random(base.shape) < 0.2] = np.nan
    base[:, 7], base[:, 9] = 5.0, np.nan
    names = [f"v{i}" for i in range(40)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in base]
    df = frame(", ".join(f"{c} double" for c in names), rows).repartition(7)
    found = {(r["a"], r["b"]): r for r in st.correlation_matrix(df, names).collect()}
    assert len(found) == 40 * 39 // 2
    for (a, b), r in found.items():
        x, y = base[:, names.index(a)], base[:, names.index(b)]
        both = ~np.isnan(x) & ~np.isnan(y)
        assert r["n"] == both.sum()
        if {a, b} & {"v7", "v9"}:
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(np.corrcoef(x[both], y[both])[0, 1], abs=1e-9)


@pytest.mark.parametrize("parts", [None, 1, 13])
def test_rank_correlation_with_ties_and_gaps(frame, parts):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 12, 400).astype(float), rng.normal(size=400).round(1)
    y[:150] = 0.0  # one value in more than a third of the rows
    z = x + y
    rows = [(float(a), None if i % 9 == 0 else float(b), float(c), 1.0, None) for i, (a, b, c) in enumerate(zip(x, y, z))]
    df = frame("x double, y double, z double, k double, none double", rows)
    found = {(r["a"], r["b"]): r for r in st.spearman_matrix(df, ["x", "y", "z", "k", "none"], parts).collect()}

    def ranks(v):
        return np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])

    for a, b in (("x", "y"), ("x", "z"), ("y", "z")):
        i = "xyz".index(a), "xyz".index(b)
        whole = np.array([[r[i[0]], r[i[1]]] for r in rows if r[i[0]] is not None and r[i[1]] is not None])
        assert found[(a, b)]["n"] == len(whole)
        assert found[(a, b)]["rho"] == pytest.approx(np.corrcoef(ranks(whole[:, 0]), ranks(whole[:, 1]))[0, 1])
    assert found[("x", "k")]["rho"] is None and found[("x", "none")]["n"] == 0
    assert len(found) == 10 and st.spearman(df.where("x > 99"), ["x", "y"]).count() == 0


def test_rank_correlation_writes_rows_not_pairs(frame, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [tuple(map(float, r)) for r in rng.normal(size=(300, 6))]
    rows = [(None, *r[1:]) if i % 7 == 0 else r for i, r in enumerate(rows)]
    names, written, cut = list("abcdef"), [], st.cut_lineage
    monkeypatch.setattr(st, "HOT", 100)  # ranks come back by the join for many values
    monkeypatch.setattr(st, "cut_lineage", lambda df: written.append(df.count()) or cut(df))
    found = {(r["a"], r["b"]): r for r in st.spearman_matrix(frame(", ".join(f"{n} double" for n in names), rows), names).collect()}
    for (a, b), r in found.items():
        whole = np.array([(x[names.index(a)], x[names.index(b)]) for x in rows if a != "a" or x[0] is not None])
        ranks = whole.argsort(axis=0).argsort(axis=0)
        assert r["n"] == len(whole) and r["rho"] == pytest.approx(np.corrcoef(ranks.T)[0, 1])
    assert len(found) == 15 and sum(written) <= 20 * len(rows)
