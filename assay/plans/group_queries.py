"""Registered queries: predicates, groups and rankings over the sales view."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import groups as g
from assay.operators import predicates as p
from assay.operators import ranking as r
from assay.plans.helpers import rounded, rounded_as_held
from assay.sources.tables import SALES_COLUMNS, sales

SALES_SQL = (
    "WITH sales AS (SELECT "
    + ", ".join(f"{expr} AS {name}" for name, (expr, _) in SALES_COLUMNS.items())
    + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    " JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
    " JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey) "
)
# the same CTE opened for more CTEs
SALES_WITH = SALES_SQL.rstrip() + ", "

QUERIES = {
    "group_summary": lambda s, d: rounded(
        g.group_summary(sales(s, d, "region", "revenue"), "region", "revenue"), 2),
    "group_summary_by_average": lambda s, d: rounded(
        g.group_summary(sales(s, d, "brand", "profit"), "brand", "profit", "average"), 3),
    "group_compare_two": lambda s, d: rounded(
        g.group_compare_two(sales(s, d, "region", "segment", "revenue"),
                            "region", "segment", "revenue"), 2),
    "category_relationship": lambda s, d: rounded(
        g.category_relationship(sales(s, d, "ptype", "revenue"), "ptype", "revenue"), 2),
    "groups_above_average": lambda s, d: rounded(
        g.groups_vs_average(sales(s, d, "nation", "revenue"), "nation", "revenue", "above"), 2),
    "groups_below_average": lambda s, d: rounded(
        g.groups_vs_average(sales(s, d, "nation", "revenue"), "nation", "revenue", "below",
                            "average"), 2),
    "scalar_aggregates": lambda s, d: rounded(
        g.aggregate(sales(s, d, "revenue", "quantity", "profit"),
                    "revenue", "quantity", "profit"), 2),
    "row_count": lambda s, d: g.row_count(sales(s, d, "quantity")),
    "group_count": lambda s, d: g.group_count(sales(s, d, "brand"), "brand"),
    "share_of_total": lambda s, d: rounded(
        g.share_of_total(sales(s, d, "region", "segment", "revenue"), "revenue",
                         (F.lower("region") == "asia") & (F.lower("segment") == "building")),
        2, pct_of_total=5),
    "group_ratio": lambda s, d: rounded(
        g.group_ratio(sales(s, d, "returnflag", "revenue"), "returnflag", "R", "N", "revenue"),
        2, ratio=6),
    "segment_comparison": lambda s, d: rounded(
        g.segment_comparison(sales(s, d, "segment", "revenue", "profit", "quantity"),
                             "segment", "BUILDING", "MACHINERY",
                             ["revenue", "profit", "quantity"]), 4),
    "derived_metric": lambda s, d: rounded(
        g.derived_metric(sales(s, d, "revenue", "quantity"), "revenue", "quantity"), 4),
    "derived_metric_by_group": lambda s, d: rounded(
        g.derived_metric_by_group(sales(s, d, "brand", "profit", "discount"),
                                  "profit", "discount", "brand"), 3),
    "open_summary": lambda s, d: rounded(
        g.open_summary(sales(s, d, "revenue", "quantity", "discount"),
                       ["revenue", "quantity", "discount"]), 4),
    "quarter_totals": lambda s, d: rounded(
        g.quarter_totals(sales(s, d, "ts", "revenue"), "ts", "revenue"), 2),
    "compare_quarters": lambda s, d: rounded(
        g.compare_quarters(sales(s, d, "ts", "revenue"), "ts", "revenue", 4, 1),
        2, pct_difference=5),
    "seasonal_pattern": lambda s, d: rounded(
        g.seasonal_pattern(sales(s, d, "ts", "revenue"), "ts", "revenue"), 3),
    "year_total": lambda s, d: rounded(
        p.year_total(sales(s, d, "ts", "revenue"), "ts", "revenue", 1998), 2),
    "top_groups": lambda s, d: rounded(
        r.top_groups(sales(s, d, "nation", "revenue"), "nation", "revenue"), 2),
    "bottom_groups": lambda s, d: rounded(
        r.bottom_groups(sales(s, d, "nation", "profit"), "nation", "profit", "mean"), 3),
    "top_groups_by_count": lambda s, d: r.top_groups(
        sales(s, d, "brand", "revenue"), "brand", "revenue", "count"),
    "top_groups_by_std": lambda s, d: rounded(
        r.top_groups(sales(s, d, "brand", "revenue"), "brand", "revenue", "std"), 3),
    "group_summary_many": lambda s, d: rounded_as_held(g.group_summary(
        sales(s, d, "nation", "brand", "revenue").withColumn("kind", F.concat_ws(" / ", "nation", "brand")),
        "kind", "revenue"), 4),
    "group_compare_many": lambda s, d: rounded(g.group_compare_two(
        sales(s, d, "nation", "brand", "revenue"), "nation", "brand", "revenue"), 4),
    "category_relationship_many": lambda s, d: rounded(g.category_relationship(
        sales(s, d, "nation", "brand", "revenue").withColumn("kind", F.concat_ws(" / ", "nation", "brand")),
        "kind", "revenue"), 2),
    "top_combinations": lambda s, d: rounded(
        r.top_combinations(sales(s, d, "ptype", "segment", "revenue"),
                           "ptype", "segment", "revenue"), 2),
    "bottom_combinations": lambda s, d: rounded(
        r.top_combinations(sales(s, d, "region", "brand", "profit"),
                           "region", "brand", "profit", ascending=True), 2),
    "multi_criteria_rank": lambda s, d: rounded(
        r.multi_criteria_rank(sales(s, d, "nation", "revenue", "profit", "quantity"),
                              "nation", ["revenue", "profit", "quantity"], [0.5, 0.3, 0.2]), 4),
    "group_score": lambda s, d: rounded(
        r.group_score(sales(s, d, "segment", "revenue"), "segment", "revenue"), 4, total=2),
    "efficiency_rank": lambda s, d: rounded(
        r.efficiency_rank(sales(s, d, "brand", "profit", "cost"), "brand", "profit", "cost"),
        2, efficiency=6),
    "margin_rank": lambda s, d: rounded(
        r.efficiency_rank(sales(s, d, "region", "profit", "revenue"), "region", "profit",
                          revenue="revenue"), 2, efficiency=6),
    "filter_eq": lambda s, d: rounded(
        g.aggregate(p.filter_eq(sales(s, d, "region", "revenue"), "region", "Europe"),
                    "revenue"), 2),
    "resolve_threshold": lambda s, d: rounded(
        p.resolve_thresholds(sales(s, d, "revenue", "quantity"), {
            "high": ("revenue", "high"), "low": ("revenue", "low"),
            "very_high": ("revenue", "very high"), "very_low": ("revenue", "very low"),
            "typical": ("quantity", "typical"), "unusual": ("revenue", "unusual")}), 4),
    "threshold_analysis": lambda s, d: rounded(
        p.threshold_analysis(sales(s, d, "quantity", "revenue"), "quantity", 40, "revenue"),
        2, target_mean=4, target_median=4),
    "compound_filter": lambda s, d: rounded(
        p.compound_filter(sales(s, d, "revenue", "discount"),
                          ("revenue", "high"), ("discount", "low")), 4),
    "count_where_greater": lambda s, d: rounded(
        p.count_where_greater(sales(s, d, "cost", "revenue"), "cost", "revenue")),
    "compound_count": lambda s, d: rounded(
        p.compound_count(sales(s, d, "discount", "profit"), "discount", 0.05, "profit")),
    "scenario_means": lambda s, d: rounded(
        p.scenario_means(sales(s, d, "quantity", "revenue"), "quantity", "revenue", "high"), 4),
    "what_if": lambda s, d: rounded(
        p.what_if(sales(s, d, "quantity", "revenue"), "quantity", "revenue", 40.0), 4),
    "complete_pairs": lambda s, d: g.row_count(
        p.complete_pairs(sales(s, d, "tax", "discount")
                         .withColumn("tax", F.nullif("tax", F.lit(0.0)))
                         .withColumn("discount", F.nullif("discount", F.lit(0.0))),
                         "tax", "discount")),
}

_GROUPED = ("grouped AS (SELECT {k} , sum({m}) AS total, avg({m}) AS average, "
            "CAST(count({m}) AS BIGINT) AS n FROM sales WHERE {k} IS NOT NULL GROUP BY {k}) ")


def _grouped(key: str, metric: str) -> str:
    return SALES_WITH + _GROUPED.format(k=key, m=metric)


_MANY = SALES_WITH + """grouped AS (SELECT nation || ' / ' || brand AS kind, nation, brand, sum(revenue) AS total,
    avg(revenue) AS average, CAST(count(revenue) AS BIGINT) AS n FROM sales GROUP BY nation, brand)"""

ORACLE = {
    "group_summary_many": _MANY + """
        SELECT kind, round(total, 4) AS total, round(average, 4) AS average, n,
               round(avg(total) OVER (), 4) AS group_mean, CAST(count(*) OVER () AS BIGINT) AS n_groups,
               round((total / avg(total) OVER () - 1) * 100, 4) AS pct_vs_mean FROM grouped""",
    "group_compare_many": _MANY + """
        SELECT nation, brand, round(total, 4) AS total, round(avg(total) OVER (), 4) AS cell_mean, kind AS label,
               round((total / avg(total) OVER () - 1) * 100, 4) AS pct_vs_mean FROM grouped""",
    "category_relationship_many": _MANY + """
        SELECT CAST(count(*) AS BIGINT) AS n_groups, arg_max(kind, total) AS top_group,
            round(max(total), 2) AS top_value, arg_min(kind, total) AS bottom_group,
            round(min(total), 2) AS bottom_value, round(max(total) - min(total), 2) AS gap,
            round(abs((max(total) - min(total)) / min(total)) * 100, 2) AS gap_pct FROM grouped""",
    "group_summary": _grouped("region", "revenue") + """
        SELECT region, round(total, 2) AS total, round(average, 2) AS average, n,
               round(avg(total) OVER (), 2) AS group_mean, CAST(count(*) OVER () AS BIGINT) AS n_groups,
               round((total / avg(total) OVER () - 1) * 100, 2) AS pct_vs_mean FROM grouped""",
    "group_summary_by_average": _grouped("brand", "profit") + """
        SELECT brand, round(total, 3) AS total, round(average, 3) AS average, n,
               round(avg(average) OVER (), 3) AS group_mean, CAST(count(*) OVER () AS BIGINT) AS n_groups,
               round((average - avg(average) OVER ()) / abs(avg(average) OVER ()) * 100, 3)
               AS pct_vs_mean FROM grouped""",
    "group_compare_two": SALES_WITH + """grouped AS (SELECT region, segment, sum(revenue) AS total
        FROM sales GROUP BY region, segment)
        SELECT region, segment, round(total, 2) AS total, round(avg(total) OVER (), 2) AS cell_mean,
               region || ' / ' || segment AS label,
               round((total / avg(total) OVER () - 1) * 100, 2) AS pct_vs_mean FROM grouped""",
    "category_relationship": _grouped("ptype", "revenue") + """,
        best AS (SELECT * FROM grouped ORDER BY total DESC, ptype LIMIT 1),
        worst AS (SELECT * FROM grouped ORDER BY total, ptype LIMIT 1)
        SELECT (SELECT CAST(count(*) AS BIGINT) FROM grouped) AS n_groups, best.ptype AS top_group,
               round(best.total, 2) AS top_value, worst.ptype AS bottom_group,
               round(worst.total, 2) AS bottom_value, round(best.total - worst.total, 2) AS gap,
               round((best.total - worst.total) / worst.total * 100, 2) AS gap_pct
        FROM best, worst""",
    "groups_above_average": _grouped("nation", "revenue") + """
        SELECT nation, round(total, 2) AS value, round(m, 2) AS group_mean
        FROM grouped, (SELECT avg(total) AS m FROM grouped) WHERE total > m""",
    "groups_below_average": _grouped("nation", "revenue") + """
        SELECT nation, round(average, 2) AS value, round(m, 2) AS group_mean
        FROM grouped, (SELECT avg(average) AS m FROM grouped) WHERE average < m""",
    "scalar_aggregates": SALES_SQL + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(sum({c}), 2) AS total, round(avg({c}), 2) AS mean,
            CAST(count({c}) AS BIGINT) AS n, round(max({c}), 2) AS max, round(min({c}), 2) AS min
            FROM sales""" for c in ("revenue", "quantity", "profit")),
    "row_count": SALES_SQL + "SELECT CAST(count(*) AS BIGINT) AS n_rows FROM sales",
    "group_count": SALES_SQL + "SELECT CAST(count(DISTINCT brand) AS BIGINT) AS n_groups FROM sales",
    "share_of_total": SALES_SQL + """
        SELECT round(sum(revenue) FILTER (WHERE region = 'ASIA' AND segment = 'BUILDING'), 2)
               AS subset_total, round(sum(revenue), 2) AS overall_total,
               round(sum(revenue) FILTER (WHERE region = 'ASIA' AND segment = 'BUILDING')
                     / sum(revenue) * 100, 5) AS pct_of_total FROM sales""",
    "group_ratio": SALES_SQL + """
        SELECT round(a, 2) AS total_a, round(b, 2) AS total_b, round(a / b, 6) AS ratio FROM
        (SELECT sum(revenue) FILTER (WHERE returnflag = 'R') AS a,
                sum(revenue) FILTER (WHERE returnflag = 'N') AS b FROM sales)""",
    "segment_comparison": SALES_WITH + "m AS (" + " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, avg({c}) FILTER (WHERE segment = 'BUILDING') AS a,
            avg({c}) FILTER (WHERE segment = 'MACHINERY') AS b FROM sales"""
        for c in ("revenue", "profit", "quantity")) + """)
        SELECT metric, round(a, 4) AS mean_a, round(b, 4) AS mean_b, round(a - b, 4) AS difference,
               round(abs((a - b) / b) * 100, 4) AS pct_difference,
               CASE WHEN a >= b THEN 'BUILDING' ELSE 'MACHINERY' END AS winner FROM m""",
    "derived_metric": SALES_SQL + """
        SELECT round(avg(d), 4) AS mean, round(stddev_samp(d), 4) AS std, round(min(d), 4) AS min,
               round(max(d), 4) AS max, CAST(count(d) AS BIGINT) AS n,
               round(quantile_cont(d, 0.5), 4) AS median
        FROM (SELECT revenue / nullif(quantity, 0) AS d FROM sales)""",
    "derived_metric_by_group": SALES_SQL + """
        SELECT brand, round(m, 3) AS mean_ratio FROM
        (SELECT brand, avg(profit / nullif(discount, 0)) AS m FROM sales GROUP BY brand)
        ORDER BY m DESC, brand LIMIT 10""",
    "open_summary": SALES_SQL + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean,
            round(quantile_cont({c}, 0.5), 4) AS median, round(stddev_samp({c}), 4) AS std
            FROM sales""" for c in ("revenue", "quantity", "discount")),
    "quarter_totals": SALES_WITH + """q AS (SELECT 'Q' || quarter(ts) AS quarter,
        sum(revenue) AS total FROM sales GROUP BY 1)
        SELECT quarter, round(total, 2) AS total, total = max(total) OVER () AS is_peak FROM q""",
    "compare_quarters": SALES_SQL + """
        SELECT round(a, 2) AS first_total, round(b, 2) AS second_total,
               round((a - b) / b * 100, 5) AS pct_difference FROM
        (SELECT sum(revenue) FILTER (WHERE quarter(ts) = 4) AS a,
                sum(revenue) FILTER (WHERE quarter(ts) = 1) AS b FROM sales)""",
    "seasonal_pattern": SALES_WITH + """means AS (
        SELECT 'month' AS season, CAST(month(ts) AS INTEGER) AS position,
               strftime(ts, '%b') AS period, avg(revenue) AS mean FROM sales GROUP BY ALL
        UNION ALL SELECT 'weekday', CAST(isodow(ts) - 1 AS INTEGER), strftime(ts, '%a'), avg(revenue)
               FROM sales GROUP BY ALL
        UNION ALL SELECT 'quarter', CAST(quarter(ts) AS INTEGER), 'Q' || quarter(ts), avg(revenue)
               FROM sales GROUP BY ALL)
        SELECT season, position, period, round(mean, 3) AS mean,
               mean = max(mean) OVER (PARTITION BY season) AS is_peak FROM means""",
    "year_total": SALES_SQL + """
        SELECT 1998 AS year, round(sum(revenue), 2) AS total, CAST(count(*) AS BIGINT) AS n_rows
        FROM sales WHERE year(ts) = 1998""",
    "top_groups": _grouped("nation", "revenue") + """
        SELECT nation, round(total, 2) AS value FROM grouped ORDER BY total DESC, nation LIMIT 5""",
    "bottom_groups": _grouped("nation", "profit") + """
        SELECT nation, round(average, 3) AS value FROM grouped ORDER BY average, nation LIMIT 5""",
    "top_groups_by_count": SALES_SQL + """
        SELECT brand, CAST(count(*) AS BIGINT) AS value FROM sales GROUP BY brand
        ORDER BY value DESC, brand LIMIT 5""",
    "top_groups_by_std": SALES_SQL + """
        SELECT brand, round(v, 3) AS value FROM
        (SELECT brand, stddev_samp(revenue) AS v FROM sales GROUP BY brand)
        ORDER BY v DESC, brand LIMIT 5""",
    "top_combinations": SALES_SQL + """
        SELECT ptype, segment, round(t, 2) AS total, ptype || ' + ' || segment AS label FROM
        (SELECT ptype, segment, sum(revenue) AS t FROM sales GROUP BY ptype, segment)
        ORDER BY t DESC, ptype, segment LIMIT 5""",
    "bottom_combinations": SALES_SQL + """
        SELECT region, brand, round(t, 2) AS total, region || ' + ' || brand AS label FROM
        (SELECT region, brand, sum(profit) AS t FROM sales GROUP BY region, brand)
        ORDER BY t, region, brand LIMIT 5""",
    "multi_criteria_rank": SALES_WITH + """
        m AS (SELECT nation, avg(revenue) AS revenue, avg(profit) AS profit,
                     avg(quantity) AS quantity FROM sales GROUP BY nation),
        s AS (SELECT *, 0.5 * (revenue - min(revenue) OVER ()) / (max(revenue) OVER () - min(revenue) OVER ())
            + 0.3 * (profit - min(profit) OVER ()) / (max(profit) OVER () - min(profit) OVER ())
            + 0.2 * (quantity - min(quantity) OVER ()) / (max(quantity) OVER () - min(quantity) OVER ())
            AS score FROM m)
        SELECT nation, round(revenue, 4) AS revenue, round(profit, 4) AS profit,
               round(quantity, 4) AS quantity, round(score, 4) AS score
        FROM s ORDER BY s.score DESC, nation LIMIT 5""",
    "group_score": SALES_WITH + """
        g AS (SELECT segment, sum(revenue) AS total, avg(revenue) AS average,
                     CAST(count(revenue) AS BIGINT) AS n,
                     stddev_samp(revenue) / abs(avg(revenue)) AS volatility
              FROM sales GROUP BY segment),
        x AS (SELECT *, (total - min(total) OVER ()) / (max(total) OVER () - min(total) OVER ()) AS nt,
            (average - min(average) OVER ()) / (max(average) OVER () - min(average) OVER ()) AS na,
            (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()) AS nn,
            (volatility - min(volatility) OVER ()) / (max(volatility) OVER () - min(volatility) OVER ()) AS nv
            FROM g)
        SELECT segment, round(total, 2) AS total, round(average, 4) AS average, n,
               round(volatility, 4) AS volatility,
               round(greatest((nt + na + nn) / 3 - 0.25 * nv, 0), 4) AS score FROM x""",
    "efficiency_rank": SALES_SQL + """
        SELECT brand, round(sum(profit), 2) AS total_profit, round(avg(profit), 2) AS avg_profit,
               CAST(count(profit) AS BIGINT) AS n, round(sum(cost), 2) AS total_base,
               round(sum(profit) / sum(cost), 6) AS efficiency FROM sales GROUP BY brand""",
    "margin_rank": SALES_SQL + """
        SELECT region, round(sum(profit), 2) AS total_profit, round(avg(profit), 2) AS avg_profit,
               CAST(count(profit) AS BIGINT) AS n, round(sum(revenue), 2) AS total_base,
               round(sum(profit) / sum(revenue), 6) AS efficiency FROM sales GROUP BY region""",
    "filter_eq": SALES_SQL + """
        SELECT 'revenue' AS "column", round(sum(revenue), 2) AS total, round(avg(revenue), 2) AS mean,
               CAST(count(revenue) AS BIGINT) AS n, round(max(revenue), 2) AS max,
               round(min(revenue), 2) AS min FROM sales WHERE lower(region) = 'europe'""",
    "resolve_threshold": SALES_SQL + """
        SELECT round(quantile_cont(revenue, 0.75), 4) AS high, round(quantile_cont(revenue, 0.25), 4) AS low,
               round(quantile_cont(revenue, 0.9), 4) AS very_high,
               round(quantile_cont(revenue, 0.1), 4) AS very_low,
               round(quantile_cont(quantity, 0.5), 4) AS typical,
               round(2.5 * quantile_cont(revenue, 0.75) - 1.5 * quantile_cont(revenue, 0.25), 4)
               AS unusual FROM sales""",
    "threshold_analysis": SALES_SQL + """
        SELECT CAST(count(*) AS BIGINT) AS n_rows,
               round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM sales), 2) AS pct_of_data,
               round(avg(revenue), 4) AS target_mean, round(sum(revenue), 2) AS target_sum,
               round(quantile_cont(revenue, 0.5), 4) AS target_median
        FROM sales WHERE quantity >= 40""",
    "compound_filter": SALES_WITH + """
        c AS (SELECT quantile_cont(revenue, 0.75) AS a, quantile_cont(discount, 0.25) AS b FROM sales)
        SELECT round(max(a), 4) AS cutoff_a, round(max(b), 4) AS cutoff_b,
               CAST(count(*) AS BIGINT) AS n_rows,
               round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM sales), 4) AS pct_of_data,
               round(avg(revenue), 4) AS mean_a, round(min(revenue), 4) AS min_a,
               round(max(revenue), 4) AS max_a, round(avg(discount), 4) AS mean_b,
               round(min(discount), 4) AS min_b, round(max(discount), 4) AS max_b
        FROM sales, c WHERE revenue >= a AND discount <= b""",
    "count_where_greater": SALES_SQL + """
        SELECT CAST(count(*) FILTER (WHERE cost > revenue) AS BIGINT) AS n_rows,
               round(count(*) FILTER (WHERE cost > revenue) * 100.0::DOUBLE / count(*), 6)
               AS pct_of_data FROM sales""",
    "compound_count": SALES_SQL + """
        SELECT CAST(count(*) FILTER (WHERE discount >= 0.05::DOUBLE AND profit > 0) AS BIGINT) AS n_rows,
               round(count(*) FILTER (WHERE discount >= 0.05::DOUBLE AND profit > 0) * 100.0::DOUBLE
                     / count(*), 6) AS pct_of_data FROM sales""",
    "scenario_means": SALES_WITH + """
        c AS (SELECT quantile_cont(quantity, 0.75) AS t FROM sales),
        m AS (SELECT max(t) AS t, avg(revenue) FILTER (WHERE quantity >= t) AS h,
                     avg(revenue) FILTER (WHERE quantity < t) AS l,
                     CAST(count(*) FILTER (WHERE quantity >= t) AS BIGINT) AS hn,
                     CAST(count(*) FILTER (WHERE quantity < t) AS BIGINT) AS ln FROM sales, c)
        SELECT round(t, 4) AS cutoff, round(h, 4) AS high_mean, round(l, 4) AS low_mean,
               round(h - l, 4) AS difference, round(abs(h - l) / abs(l) * 100, 4) AS pct_difference,
               hn AS high_n, ln AS low_n FROM m""",
    "what_if": SALES_SQL + """
        SELECT round(mx, 4) AS current_mean, round(mx + mx * 0.4, 4) AS simulated_mean,
               round(my, 4) AS current_target_mean,
               round(my + b * mx * 0.4, 4) AS simulated_target_mean,
               round(b, 4) AS slope, round(r, 4) AS r, n FROM
        (SELECT avg(quantity) AS mx, avg(revenue) AS my, regr_slope(revenue, quantity) AS b,
                corr(revenue, quantity) AS r, CAST(count(*) AS BIGINT) AS n FROM sales)""",
    "complete_pairs": SALES_SQL + """
        SELECT CAST(count(*) AS BIGINT) AS n_rows FROM sales
        WHERE nullif(tax, 0) IS NOT NULL AND nullif(discount, 0) IS NOT NULL""",
}
