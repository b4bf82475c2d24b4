import pytest

from assay.operators import groups as g
from assay.operators import predicates as p
from assay.operators import ranking as r


def grouped(frame, n):
    return frame("k string, v double", [(f"g{i:03d}", float(i)) for i in range(n)])


def test_groups_have_no_bound_but_the_callers(frame):
    assert g.group_summary(grouped(frame, 31), "k", "v").count() == 31
    assert g.group_summary(grouped(frame, 30), "k", "v", max_groups=30).count() == 30
    assert g.group_summary(grouped(frame, 31), "k", "v", max_groups=30).count() == 0
    assert g.category_relationship(grouped(frame, 31), "k", "v").first()["n_groups"] == 31
    assert g.category_relationship(grouped(frame, 31), "k", "v", max_groups=30).count() == 0


def test_missing_keys_are_dropped_and_empty_totals_are_zero(frame):
    df = frame("k string, v double", [("a", None), ("a", None), (None, 5.0), ("b", 2.0)])
    rows = {x["k"]: x for x in g.group_summary(df, "k", "v").collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"]["total"], rows["a"]["n"], rows["a"]["average"]) == (0.0, 0, None)


def test_ties_go_to_the_smaller_key(frame):
    df = frame("k string, v double", [("b", 1.0), ("a", 1.0), ("c", 1.0)])
    assert [x["k"] for x in r.top_groups(df, "k", "v", n=2).collect()] == ["a", "b"]
    row = g.category_relationship(df, "k", "v").first()
    assert (row["top_group"], row["bottom_group"], row["gap"]) == ("a", "a", 0.0)


def test_equal_metrics_score_a_half(frame):
    df = frame("k string, v double, w double", [("a", 1.0, 3.0), ("b", 1.0, 5.0)])
    rows = {x["k"]: x["score"] for x in r.multi_criteria_rank(df, "k", ["v", "w"]).collect()}
    assert rows == {"a": 0.25, "b": 0.75}


def test_single_row_groups_have_no_volatility(frame):
    df = frame("k string, v double", [("a", 1.0), ("b", 2.0), ("b", 4.0)])
    rows = {x["k"]: x for x in r.group_score(df, "k", "v").collect()}
    assert rows["a"]["volatility"] == 0.0 and rows["a"]["score"] == 0.0
    assert rows["b"]["score"] == pytest.approx(1 - 0.25)


def test_zero_denominators(frame):
    df = frame("k string, a double, b double", [("x", 1.0, 0.0), ("x", 4.0, 2.0), ("y", 3.0, 0.0)])
    row = g.derived_metric(df, "a", "b").first()
    assert (row["n"], row["mean"]) == (1, 2.0)
    assert [tuple(x) for x in g.derived_metric_by_group(df, "a", "b", "k").collect()] == [("x", 2.0)]
    ranks = {x["k"]: x["efficiency"] for x in r.efficiency_rank(df, "k", "a", "b").collect()}
    assert ranks == {"x": 2.5, "y": 0.0}
    assert g.group_ratio(df, "k", "x", "none", "a").first()["ratio"] == pytest.approx(5e9)


def test_two_category_limit_counts_possible_cells(frame):
    df = frame("a int, b int, v double", [(i, i, 1.0) for i in range(11)])
    assert g.group_compare_two(df, "a", "b", "v").count() == 11
    assert g.group_compare_two(df, "a", "b", "v", max_cells=120).count() == 0       # 121 cells
    assert g.group_compare_two(df.filter("a < 10"), "a", "b", "v", max_cells=120).count() == 10


def test_filter_ignores_case_and_type(frame):
    df = frame("s string, n int", [("North", 1), ("NORTH", 2), ("South", 3)])
    assert p.filter_eq(df, "s", "north").count() == 2
    assert p.filter_eq(df, "n", "3").count() == 1


def test_words_for_thresholds(frame):
    df = frame("v double", [(float(i),) for i in range(101)])
    row = p.resolve_thresholds(df, {w.replace(" ", "_"): ("v", w) for w in (
        "high", "low", "very high", "very low", "average", "unusual", "whatever")}).first().asDict()
    assert row == {"high": 75.0, "low": 25.0, "very_high": 90.0, "very_low": 10.0, "average": 50.0,
                   "unusual": 150.0, "whatever": 75.0}


def test_low_word_filters_below(frame):
    df = frame("v double, w double", [(float(i), float(100 - i)) for i in range(101)])
    row = p.compound_filter(df, ("v", "low"), ("w", "high")).first()
    assert (row["n_rows"], row["max_a"], row["min_b"]) == (26, 25.0, 75.0)
    assert p.threshold_analysis(df, "v", 10, "w", "below").first()["n_rows"] == 11


def test_scenario_needs_two_rows_each_side(frame):
    assert p.scenario_means(frame("v double, w double", [(1.0, 1.0), (2.0, 2.0)]), "v", "w").count() == 0


def test_seasons(frame):
    df = frame("d string, v double", [("2024-01-01", 1.0), ("2024-01-08", 3.0), ("2024-04-02", 9.0)]) \
        .selectExpr("cast(d as timestamp_ntz) as d", "v")
    rows = {(x["season"], x["period"]): (x["mean"], x["is_peak"])
            for x in g.seasonal_pattern(df, "d", "v").collect()}
    assert rows == {("month", "Jan"): (2.0, False), ("month", "Apr"): (9.0, True),
                    ("weekday", "Mon"): (2.0, False), ("weekday", "Tue"): (9.0, True),
                    ("quarter", "Q1"): (2.0, False), ("quarter", "Q2"): (9.0, True)}


def test_typed_columns(frame):
    from assay.operators.profiling import profile
    prof = profile(frame("a double, b int, c string", [(float(i), i % 2, f"x{i}") for i in range(25)]))
    assert p.typed_columns(prof, "numeric", "boolean") == ["a", "b"]
    assert p.metric_columns(prof) == ["a"]
