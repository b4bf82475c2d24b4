"""The autonomous run: profile, clean, analyse, model, rank.

Each analysis is one fused pass over the clean frame for all its columns. What comes back to be
assembled into findings is the summary of each analysis (a row per column, a row per group,
ten bins, the cells of a grid, one row per month), never data rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.exprs import unpivot
from assay.functions.orderstats import LIMIT
from assay.operators import cleaning, insights, models, profiling, ranking, stats, timeseries
from assay.session import cut_lineage, keep

MIN_ROWS_CORRELATION = 10

#: largest groups that a finding's chart shows one by one, and what the others together are called
CHART_GROUPS, OTHERS = 1000, "(all others)"

# Parts of column names that are never summed up in a concentration analysis.
NOT_ADDITIVE = ("id", "index", "rank", "year", "month", "day", "code", "num", "no")


@dataclass
class Analysis:
    profile: DataFrame
    clean: DataFrame
    audit: DataFrame
    gates: DataFrame
    insights: DataFrame     # all findings
    ranked: DataFrame       # the ten best, validated


class _Findings:
    """Collects rows of the insight schema."""

    def __init__(self, meta: dict, n_rows: int):
        self.meta, self.n_rows, self.rows = meta, n_rows, []

    def null_rate(self, column: str) -> float:
        return self.meta[column]["null_rate"] if column in self.meta else 0.0

    def warning(self, column: str, n: int) -> str | None:
        rate = self.null_rate(column)
        if rate > 0.3:
            return "high" if rate > 0.6 else "medium"
        return "medium" if n < 30 else None

    def add(self, name: str, module: str, kind: str, columns: list[str], metrics: dict,
            impact: float, confidence: float, warning: str | None, n_rows: int,
            chart: list[tuple] = (), labels: dict | None = None) -> None:
        self.rows.append((
            f"{name}:{','.join(columns)}", module, kind, columns,
            {k: float(v) for k, v in metrics.items() if v is not None}, labels or {},
            float(min(1.0, max(0.0, impact))), float(min(1.0, confidence)), warning, int(n_rows),
            [(str(c[0]), float(c[1]), c[2] if len(c) > 2 else None) for c in chart]))


def statistical_findings(df: DataFrame, meta: dict, n_rows: int, limit: int = LIMIT) -> list[tuple]:
    """Distribution, correlation, group, trend, ranking, missing, shape and concentration rows."""
    def of_type(dtype: str) -> list[str]:
        return [c for c, m in meta.items() if m["dtype"] == dtype and c in df.columns]

    numeric, words, dates = of_type("numeric"), of_type("categorical"), of_type("datetime")
    out = _Findings(meta, n_rows)
    if numeric:
        _distributions(df, numeric, out, limit)
    if len(numeric) >= 2 and n_rows >= MIN_ROWS_CORRELATION:
        _correlations(df, numeric, out)
    if words and numeric:
        _groups(df, words, numeric, out)
    for ts in dates:
        for metric in numeric:
            _trend(df, ts, metric, out)
    _missing(df, out)
    additive = [c for c in numeric if not any(p in c.lower() for p in NOT_ADDITIVE)]
    for c in additive:
        _pareto(df, c, out)
    return out.rows


def _distributions(df: DataFrame, numeric: list[str], out: _Findings, limit: int) -> None:
    bins: dict[str, list] = {}
    for r in profiling.histograms(df, numeric).orderBy("column", "bin").collect():
        bins.setdefault(r["column"], []).append((f"{r['low']:.6g} - {r['high']:.6g}", r["n"]))
    for r in stats.describe(df, numeric, limit).collect():
        c = r["column"]
        out.add("describe", "statistics", "distribution", [c],
                {k: r[k] for k in ("mean", "median", "std", "min", "max", "range", "n")},
                r["impact"], max(0.5, 1 - out.null_rate(c)), out.warning(c, r["n"]), r["n"],
                bins.get(c, []))
    for r in stats.shape_stats(df, numeric).collect():
        c = r["column"]
        out.add("shape", "statistics", "distribution", [c],
                {"skewness": r["skewness"], "kurtosis": r["kurtosis"]}, abs(r["skewness"]) / 3,
                max(0.5, 1 - out.null_rate(c)), out.warning(c, r["n"]), r["n"], bins.get(c, []),
                {"direction": r["direction"]})


def _correlations(df: DataFrame, numeric: list[str], out: _Findings) -> None:
    for r in stats.correlation_pairs(df, numeric, top=None).collect():
        points = [(p["x"], p["y"]) for p in stats.scatter(df, r["a"], r["b"]).collect()]  # grid cells
        out.add("correlation", "statistics", "correlation", [r["a"], r["b"]],
                {"correlation": r["r"]}, abs(r["r"]), out.n_rows / 100, None, r["n"], points,
                {"strength": r["strength"], "direction": r["direction"]})


def _groups(df: DataFrame, words: list[str], numeric: list[str], out: _Findings) -> None:
    """All category x measure summaries in one pass, and the top five of each.

    Leader, mean and distance are aggregates over every group, however many there are. The chart has
    the largest groups and one exact point for all others together.
    """
    if not words or not numeric:
        return
    cells = unpivot(df, [(F.lit(c), F.lit(m), F.col(f"`{c}`").cast("string"),
                          profiling.as_double(df, m)) for c in words for m in numeric],
                    ["category", "measure", "grp", "x"])
    totals = cut_lineage(cells.filter("grp IS NOT NULL").groupBy("category", "measure", "grp")
                         .agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("total")))
    pair = ["category", "measure"]
    facts = {(r["category"], r["measure"]): r for r in totals.groupBy(*pair).agg(
        F.avg("total").alias("mean"), F.sum("total").alias("sum"), F.count("*").alias("n")).collect()}
    order = Window.partitionBy(*pair).orderBy(F.col("total").desc(), "grp")
    charts: dict[tuple, list] = {}
    for r in (totals.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= CHART_GROUPS)
              .orderBy(*pair, "place").collect()):  # at most CHART_GROUPS rows a pair
        charts.setdefault((r["category"], r["measure"]), []).append((r["grp"], r["total"]))
    for c in words:
        for m in numeric:
            if (c, m) not in facts:
                continue
            fact, chart = facts[c, m], charts[c, m]
            leader, top = chart[0]
            above = (top - fact["mean"]) / max(abs(fact["mean"]), 1e-9) * 100
            rest = [(OTHERS, fact["sum"] - sum(t for _, t in chart))] if fact["n"] > len(chart) else []
            out.add("groups", "statistics", "ranking", [c, m],
                    {"top_total": top, "group_mean": fact["mean"], "pct_above_mean": above},
                    abs(above) / 100, max(0.4, 1 - out.null_rate(m)), out.warning(m, out.n_rows),
                    out.n_rows, chart + rest, {"leader": leader})
            out.add("top", "statistics", "ranking", [c, m], {"top_total": top},
                    0.7, max(0.4, 1 - out.null_rate(m)), None, out.n_rows,
                    chart[:ranking.TOP_N], {"leader": leader})


def _trend(df: DataFrame, ts: str, metric: str, out: _Findings) -> None:
    row = timeseries.trend(df, ts, metric, min_months=2).first()
    if row is None:
        return
    months = timeseries.monthly_totals(df, ts, metric).orderBy("period").collect()
    out.add("trend", "statistics", "trend", [ts, metric],
            {k: row[k] for k in ("slope", "r_squared", "p_value", "peak_value")},
            abs(row["peak_pct_above_mean"]) / 100, 0.4 + 0.6 * row["r_squared"],
            out.warning(metric, row["n_months"]), row["n_months"],
            [(m["period"], m["value"]) for m in months],
            {"direction": row["direction"], "peak_period": row["peak_period"]})


def _missing(df: DataFrame, out: _Findings) -> None:
    rows = profiling.missing_summary(df).collect()
    if rows:
        out.add("missing", "statistics", "missing_data", [r["column"] for r in rows],
                {"worst_pct": rows[0]["missing_pct"], "n_columns": len(rows)},
                rows[0]["missing_pct"] / 100, 1.0, None, out.n_rows,
                [(r["column"], r["missing_pct"]) for r in rows])


def _pareto(df: DataFrame, column: str, out: _Findings) -> None:
    row = stats.pareto(df, column).first()
    if row:
        curve = stats.cumulative_share(df, column).orderBy("pct_rows").collect()
        out.add("pareto", "statistics", "ranking", [column],
                {k: row[k] for k in ("top_20_pct", "pct_rows_for_80", "total")},
                (row["top_20_pct"] - 40) / 60, max(0.5, 1 - out.null_rate(column)), None,
                out.n_rows, [(f"{p['pct_rows']:.1f}%", p["pct_value"]) for p in curve])


def model_findings(df: DataFrame, meta: dict, gates: dict[str, str], target: str | None,
                   n_rows: int, limit: int = LIMIT, starts: int = models.STARTS,
                   max_depth: int = models.MAX_DEPTH) -> list[tuple]:
    """One finding per model that the gates let run."""
    out = _Findings(meta, n_rows)
    numeric = [c for c, m in meta.items() if c in df.columns and m["dtype"] == "numeric"]
    numeric += [c for c, m in meta.items() if c in df.columns and m["is_binary"]]
    if gates["feature_importance"] == "run" and target in df.columns and len(numeric) >= 2:
        rows = models.feature_importance(df, target, numeric, max_depth=max_depth).collect()
        if rows:
            r2 = rows[0]["r_squared"]
            weak = "medium" if r2 < 0.3 or out.null_rate(target) > 0.3 else None
            out.add("importance", "models", "correlation", [target] + [r["feature"] for r in rows],
                    {"r_squared": r2, "top_importance": rows[0]["importance"]}, r2, 0.5 + 0.5 * r2,
                    weak, rows[0]["n_rows"], [(r["feature"], r["importance_pct"]) for r in rows],
                    {"model": "random forest", "top_feature": rows[0]["feature"]})
    if gates["segments"] == "run":
        found = models.fit_segments(df, numeric, starts=starts)
        if found:
            sizes = models.segment_profiles(found).collect()
            order = [r["column"] for r in models.segment_differences(found).collect()]
            out.add("segments", "models", "segment", found.columns,
                    {"silhouette": found.silhouette, "k": found.k}, found.silhouette + 0.2,
                    0.4 + 0.6 * found.silhouette, "medium" if found.silhouette < 0.3 else None,
                    n_rows, [(f"Segment {r['segment'] + 1}", r["size"]) for r in sizes],
                    {"model": "k-means", "differ_by": ", ".join(order[:2])})
    if gates["anomalies"] == "run":
        scored = models.anomalies(df, numeric, limit=limit)
        if scored is not None:
            used = [c for c in numeric if c in scored.columns]
            s = models.anomaly_summary(scored).first()
            stand = models.standout_columns(scored, used).first()
            bins = profiling.histogram(scored, "anomaly_score").orderBy("bin").collect()
            out.add("anomalies", "models", "anomaly", used,
                    {"n_anomalies": s["n_anomalies"], "anomaly_pct": s["anomaly_pct"]},
                    s["anomaly_pct"] / 10 + 0.3, 0.6 + s["n_rows"] / 1000 * 0.4, None, s["n_rows"],
                    [(f"{b['low']:.4f} - {b['high']:.4f}", b["n"]) for b in bins],
                    {"model": "isolation forest", "stands_out_on": stand["column"]})
    dates = [c for c, m in meta.items() if c in df.columns and m["dtype"] == "datetime"]
    for ts, metric in product(dates, numeric) if gates["forecast"] == "run" else ():
        series = keep(models.forecast(df, ts, metric))
        rows = series.orderBy("period").collect()
        if rows:
            change = timeseries.forecast_change(series).first()
            months = sum(r["type"] == "historical" for r in rows)
            out.add("forecast", "models", "trend", [ts, metric],
                    {"next_forecast": change["next_forecast"], "change_pct": change["change_pct"]},
                    change["change_pct"] / 50 + 0.4,
                    max(0.4, 1 - out.null_rate(metric) - (0.1 if months < 24 else 0.0)), "low",
                    len(rows), [(r["period"], r["value"], r["type"]) for r in rows],
                    {"model": "exponential smoothing", "direction": change["direction"]})
        series.unpersist()
    return out.rows


def analyse(df: DataFrame, target: str | None = None, limit: int = LIMIT, starts: int = models.STARTS,
            max_depth: int = models.MAX_DEPTH) -> Analysis:
    """Profile and clean a table, run every analysis and model it qualifies for, rank the findings.

    ``target`` overrides the detected outcome column; ``starts`` and ``max_depth`` are those of the
    segments and the forest.
    """
    spark = df.sparkSession
    prof = profiling.profile(df, limit=limit)
    meta = {r["column"]: r for r in prof.collect()}
    clean, audit = cleaning.clean(df, prof, limit)
    clean = cut_lineage(clean)
    n_rows = clean.count()
    found = profiling.target_column(prof).first()
    target = target or (found["column"] if found else None)
    gates = models.ml_gates(prof)
    status = {r["model"]: r["status"] for r in gates.collect()}
    rows = statistical_findings(clean, meta, n_rows, limit)
    rows += model_findings(clean, meta, status, target, n_rows, limit, starts, max_depth)
    table = spark.createDataFrame(rows, insights.INSIGHT_SCHEMA)
    return Analysis(prof, clean, audit, gates, table,
                    insights.validate(insights.rank(table), prof))
