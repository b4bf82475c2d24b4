import json

import pytest

from assay.operators import insights as i
from assay.operators.profiling import profile
from assay.plans.analysis import analyse


def findings(frame, rows):
    full = [(f"{k:02d}", "statistics", kind, ["v"], {"p_value": 0.01, "other": 1.0}, {}, impact,
             confidence, warning, n, []) for k, (kind, impact, confidence, warning, n) in enumerate(rows)]
    return frame(i.INSIGHT_SCHEMA, full)


def test_score_formula_and_warnings(frame):
    df = findings(frame, [("trend", 0.8, 0.6, None, 50), ("trend", 0.8, 0.6, "medium", 50),
                          ("trend", 0.8, 0.6, "high", 50), ("odd", 0.0, 0.0, "low", 50)])
    got = [r["composite"] for r in i.score(df).orderBy("insight_id").collect()]
    base = 0.5 * 0.8 + 0.35 * 0.6 + 0.15
    assert got == pytest.approx([base, base * 0.85, base * 0.70, 0.075])


def test_two_distributions_and_ten_rows_at_most(frame):
    df = findings(frame, [("distribution", 1.0, 1.0, None, 9)] * 5 + [("trend", 0.1, 0.1, None, 9)] * 12)
    rows = i.rank(df).collect()
    assert [r["rank"] for r in rows] == list(range(1, 11))
    assert [r["type"] for r in rows] == ["distribution"] * 2 + ["trend"] * 8


def test_validation(frame):
    prof = profile(frame("v double, w double", [(None if k % 4 == 0 else float(k), float(k))
                                                for k in range(40)]))
    df = i.validate(i.rank(findings(frame, [("trend", 0.5, 1.0, None, 200), ("trend", 0.4, 0.2, "high", 10)])),
                    prof)
    strong, weak = df.collect()
    assert strong["completeness"] == 0.75
    assert strong["validation"] == pytest.approx(0.55 + 0.25 * 0.75 + 0.2)
    assert strong["evidence"] == "Strong" and strong["caveats"] == ["missing values in the columns used"]
    assert weak["validation"] == pytest.approx(0.11 + 0.1875 + 0.02 - 0.18)
    assert weak["evidence"] == "Exploratory" and len(weak["caveats"]) == 3
    assert strong["evidence_metrics"] == {"completeness": 0.75, "p_value": 0.01}


@pytest.fixture(scope="module")
def run(spark):
    rows = []
    for k in range(240):
        month, region = k % 24, "NSEW"[k % 4]
        revenue = 1000 + 40 * month + 100 * (k % 4) + (k * 37 % 11)
        rows.append((f"{2022 + month // 12}-{month % 12 + 1:02d}-05", region, float(revenue),
                     float(revenue * 0.6 + k % 3), float(k % 5) if k % 3 else None))
    rows[7] = ("2022-08-05", "E", 90000.0, 10.0, 1.0)
    return analyse(spark.createDataFrame(
        rows, "day string, region string, revenue double, cost double, rating double"), starts=1, max_depth=5)


def test_whole_run(run):
    ranked = run.ranked.collect()
    assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1)) and len(ranked) == 10
    scores = [r["composite"] for r in ranked]
    assert scores == sorted(scores, reverse=True) and all(0 <= s <= 1 for s in scores)
    kinds = {r["insight_id"].split(":")[0] for r in run.insights.collect()}
    assert {"describe", "shape", "groups", "top", "trend", "importance", "segments", "anomalies",
            "forecast"} <= kinds
    assert {r["status"] for r in run.gates.collect()} == {"run"}
    assert run.clean.filter("rating IS NULL").count() == 0


def test_reports_and_exports(run, spark, tmp_path):
    from assay.operators.profiling import summary
    from assay.sources import sinks
    row = i.run_summary(run.gates, run.ranked).first()
    assert (row["n_run"], row["n_skipped"], row["n_insights"]) == (4, 0, 10)
    table = i.insight_table(run.ranked)
    sinks.write_insights(run.ranked, str(tmp_path / "insights"))
    assert spark.read.option("header", True).csv(str(tmp_path / "insights")).count() == 10
    name = table.filter("has_chart = 'yes'").first()["insight_id"]
    sinks.write_chart(run.ranked, name, str(tmp_path / "chart"))
    assert spark.read.option("header", True).csv(str(tmp_path / "chart")).columns == ["label", "value", "group"]
    card = summary(run.clean, run.profile)
    document = sinks.bundle(card, run.audit, run.gates, run.ranked)
    sinks.write_bundle(document, str(tmp_path / "bundle"))
    data = json.loads(spark.read.text(str(tmp_path / "bundle")).first()[0])
    assert len(data["insights"]) == 10 and data["dataset"]["n_rows"] == 240
    for session in ("s1", "s2"):
        sinks.append_session(run.ranked, session, str(tmp_path / "sessions"))
    assert spark.read.parquet(str(tmp_path / "sessions")).groupBy("session_id").count().count() == 2


def test_small_table_closes_all_gates(frame):
    out = analyse(frame("item string, price double", [("a", 1.5), ("b", 2.5), ("c", 9.0)]))
    assert {r["status"] for r in out.gates.collect()} == {"skipped"}
    assert {r["type"] for r in out.ranked.collect()} <= {"distribution", "ranking"}


def test_odd_column_names(frame):
    from assay.operators import ranking
    rows = [(f"g {k % 4}", float(k % 17), float(k * 3 % 29), f"2024-{k % 12 + 1:02d}-01", k % 2)
            for k in range(120)]
    df = frame("`Lead Studio` string, `unit.price` double, `Rotten Tomatoes %` double,"
               " `order.date` string, `is.new` int", rows)
    out = analyse(df, starts=1, max_depth=5)
    assert out.ranked.count() == 10
    assert {r["insight_id"].split(":")[0] for r in out.insights.collect()} >= {
        "describe", "groups", "trend", "segments", "anomalies", "forecast", "importance"}
    best = ranking.multi_criteria_rank(df, "Lead Studio", ["unit.price", "Rotten Tomatoes %"])
    assert best.count() == 4


def test_groups_of_any_number_keep_leader_mean_and_an_exact_rest(frame):
    from assay.plans import analysis
    from assay.operators import profiling
    n = analysis.CHART_GROUPS + 200
    df = frame("k string, v double", [(f"g{i:05d}", float(i)) for i in range(n)] + [("g00003", 10.0 * n), (None, 1e9)])
    meta = {r["column"]: r.asDict() for r in profiling.profile(df).collect()}
    out = analysis._Findings(meta, n + 2)
    analysis._groups(df, ["k"], ["v"], out)
    assert len(out.rows) == 2
    text = repr(out.rows[0])
    total = n * (n - 1) / 2 + 10.0 * n
    shown = 3 + 10.0 * n + sum(range(n - analysis.CHART_GROUPS + 1, n))
    assert "g00003" in text and repr((analysis.OTHERS, total - shown, None)) in text
    assert str(total / n) in text
