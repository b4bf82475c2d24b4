"""The plans stay the ones wanted at scale."""

import pytest

from assay.operators import groups, profiling, ranking
from assay.operators.profiling import sample_values
from assay.plans.catalog import QUERIES
from assay.sources.tables import sales, table

# these run models or the whole pipeline while they are built
EAGER = {n for n in QUERIES if n.startswith(("segment", "anomal", "top_anom", "insight_ch", "insight_va",
                                             "clean_a", "clean_r", "audit"))}
EAGER |= {"analyse", "run_summary", "json_bundle", "feature_importance"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df).split("Initial Plan")[0]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_joins_and_no_row_at_a_time_python(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in text


@pytest.mark.parametrize("build", [
    lambda df: groups.group_summary(df, "returnflag", "revenue"),
    lambda df: groups.groups_vs_average(df, "returnflag", "revenue"),
    lambda df: ranking.group_score(df, "returnflag", "revenue"),
    lambda df: ranking.multi_criteria_rank(df, "returnflag", ["revenue", "quantity"]),
    lambda df: groups.quarter_totals(df, "ts", "revenue"),
])
def test_groups_and_their_totals_share_one_shuffle(build, spark, sf_dir):
    df = build(sales(spark, sf_dir, "returnflag", "revenue", "quantity", "ts"))
    assert "ReusedExchange" in final_plan(df)


def test_year_filter_reaches_the_scan(spark, sf_dir):
    scan = [line for line in plan(QUERIES["year_total"](spark, sf_dir)).split("\n") if "FileScan" in line]
    assert len(scan) == 1 and "l_shipdate" in scan[0].split("DataFilters")[1]
    assert "l_tax" not in scan[0] and "l_quantity" not in scan[0]


def test_samples_are_cut_before_the_shuffle(spark, sf_dir):
    text = plan(sample_values(table(spark, sf_dir, "orders")))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_top_n_is_one_take_ordered_step(spark, sf_dir):
    df = ranking.top_groups(sales(spark, sf_dir, "returnflag", "revenue"), "returnflag", "revenue")
    assert "TakeOrderedAndProject" in plan(df)


def test_typed_columns_joins_once(spark, sf_dir, monkeypatch):
    seen, profile = [], profiling.profile
    monkeypatch.setattr(profiling, "profile", lambda df: seen.append(plan(df)) or profile(df))
    assert QUERIES["typed_columns"](spark, sf_dir).count() == 5
    assert len(seen) == 1 and "Join" not in seen[0]
