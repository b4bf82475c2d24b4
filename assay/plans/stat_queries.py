"""Registered queries: profiles, statistics and monthly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import profiling as p
from assay.operators import stats as st
from assay.operators import timeseries as t
from assay.plans.group_queries import SALES_SQL, SALES_WITH
from assay.plans.helpers import once, rounded
from assay.session import cut_lineage
from assay.sources.tables import DIRTY_COLUMNS, dirty_sales, sales, table

DIRTY_SQL = (
    "WITH dirty AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in DIRTY_COLUMNS.items())
    + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    " JOIN customer ON o_custkey = c_custkey) "
)
DIRTY_WITH = DIRTY_SQL.rstrip() + ", "
MEASURES = ["revenue", "quantity", "discount", "profit"]
# interpolation of values with four decimals gives six: seven never falls on a rounding edge
QUANTILES = {"q1": 7, "median": 7, "q3": 7}


def _gappy_orders(spark, sf_dir):
    """Orders with repeated rows: keys and prices dropped, so equal rows occur."""
    return table(spark, sf_dir, "orders").select(
        "o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("y"),
        F.month("o_orderdate").alias("m"))


@once
def _dirty_profile(spark, sf_dir):
    return p.profile(cut_lineage(dirty_sales(spark, sf_dir)))


NARROW = 300    # distinct values that one task may order: far fewer than these tables have
RANGES = 50  # ranges of values that a concentration is spread over


RANKED = ["revenue", "quantity", "sparse", "row_id"]


def _spearman_sql(source: str, columns: list[str]) -> str:
    """Average ranks over the complete rows of each pair, then Pearson r."""
    def rank(c: str) -> str:
        return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    pairs = " UNION ALL ".join(
        f"""SELECT '{a}' AS a, '{b}' AS b, corr(x, y) AS rho, CAST(count(*) AS BIGINT) AS n FROM
            (SELECT {rank(a)} AS x, {rank(b)} AS y FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
        for i, a in enumerate(columns) for b in columns[i + 1:])
    return f"""pairs AS ({pairs})
        SELECT a, b, round(rho, 6) AS rho, n, CASE WHEN abs(rho) >= 0.8 THEN 'very strong'
            WHEN abs(rho) >= 0.6 THEN 'strong' WHEN abs(rho) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
            CASE WHEN rho > 0 THEN 'positive' ELSE 'negative' END AS direction FROM pairs
        WHERE rho IS NOT NULL AND NOT isnan(rho)"""


QUERIES = {
    "null_profile": lambda s, d: rounded(p.null_profile(dirty_sales(s, d))),
    "missing_summary": lambda s, d: rounded(p.missing_summary(dirty_sales(s, d))),
    "cardinality": lambda s, d: p.cardinality(dirty_sales(s, d)),
    "sample_values": lambda s, d: p.sample_values(dirty_sales(
        s, d, "row_id", "segment", "quantity", "flag", "day_txt")).select(
            "column", F.concat_ws("|", "samples").alias("samples")),
    "infer_types": lambda s, d: rounded(p.infer_types(dirty_sales(s, d))),
    "duplicate_count": lambda s, d: p.duplicate_count(_gappy_orders(s, d)),
    "numeric_stats": lambda s, d: rounded(p.numeric_stats(
        sales(s, d, *MEASURES), MEASURES), 4, **QUANTILES),
    "numeric_stats_dirty": lambda s, d: rounded(p.numeric_stats(
        dirty_sales(s, d, "revenue", "units_txt", "sparse"), ["revenue", "units_txt", "sparse"]), 4,
        **QUANTILES),
    "iqr_outliers": lambda s, d: rounded(p.iqr_outliers(
        table(s, d, "events"), ["value", "user_id"]), 4),
    "histogram": lambda s, d: rounded(p.histogram(table(s, d, "events"), "value"), 4),
    "top_values": lambda s, d: rounded(p.top_values(sales(s, d, "brand"), "brand")),
    "binary_values": lambda s, d: rounded(p.top_values(
        table(s, d, "labels"), "quality", binary=True)),
    "outlier_values": lambda s, d: rounded(p.outlier_values(table(s, d, "events"), "value"), 4),
    "column_detail": lambda s, d: rounded(p.column_detail(table(s, d, "events"), "value"), 4),
    "compare_versions": lambda s, d: rounded(p.compare_versions(
        table(s, d, "events"), table(s, d, "events").filter("value < 200"), "value"), 4),
    "profile": lambda s, d: rounded(_dirty_profile(s, d).drop("samples"), 4, **QUANTILES),
    "quality_flags": lambda s, d: p.quality_flags(_dirty_profile(s, d)),
    "overview": lambda s, d: rounded(p.overview(_dirty_profile(s, d))),
    "summary_card": lambda s, d: rounded(
        p.summary(_gappy_orders(s, d), p.profile(_gappy_orders(s, d)))),
    "target_column": lambda s, d: p.target_column(p.profile(cut_lineage(sales(s, d, *MEASURES, "region")))),
    "describe": lambda s, d: rounded(st.describe(
        dirty_sales(s, d, "revenue", "quantity"), ["revenue", "quantity"]), 4, confidence=6, **QUANTILES),
    "correlation_pairs": lambda s, d: rounded(st.correlation_pairs(
        sales(s, d, *MEASURES), MEASURES), 6),
    "correlation_all": lambda s, d: rounded(st.correlation_pairs(
        dirty_sales(s, d, "revenue", "quantity", "sparse", "row_id"),
        ["revenue", "quantity", "sparse", "row_id"], min_abs=0.0, top=None), 6),
    "spearman": lambda s, d: rounded(st.spearman(
        dirty_sales(s, d, "revenue", "quantity", "sparse", "row_id"), RANKED), 6),
    "spearman_narrowed": lambda s, d: rounded(st.spearman(
        sales(s, d, *MEASURES), MEASURES, parts=RANGES), 6),
    "correlation": lambda s, d: rounded(st.correlation(
        sales(s, d, "quantity", "revenue"), "quantity", "revenue").drop("p_value", "significant"), 6),
    "shape_stats": lambda s, d: rounded(st.shape_stats(
        table(s, d, "events"), ["value", "user_id"], min_skew=0.0), 5),
    "pareto": lambda s, d: rounded(st.pareto(table(s, d, "events"), "value"), 4),
    "pareto_narrowed": lambda s, d: rounded(st.pareto(table(s, d, "events"), "value", parts=RANGES), 4),
    "cumulative_share_narrowed": lambda s, d: rounded(
        st.cumulative_share(table(s, d, "events"), "value", parts=RANGES), 4),
    "numeric_stats_narrowed": lambda s, d: rounded(p.numeric_stats(
        sales(s, d, *MEASURES), MEASURES, NARROW), 4, **QUANTILES),
    "cumulative_share": lambda s, d: rounded(st.cumulative_share(table(s, d, "events"), "value"), 4),
    "factor_influence": lambda s, d: rounded(st.factor_influence(
        sales(s, d, "revenue", "quantity", "discount", "tax", "region", "segment", "brand"),
        "revenue", ["quantity", "discount", "tax"], ["region", "segment", "brand"]).drop("p_value"),
        5, spread=3),
    "monthly_trend": lambda s, d: rounded(t.trend(sales(s, d, "ts", "revenue"), "ts", "revenue")
                                          .drop("p_value"), 2, r_squared=6),
    "monthly_totals": lambda s, d: rounded(t.monthly_totals(
        sales(s, d, "ts", "revenue"), "ts", "revenue"), 2),
    "period_growth": lambda s, d: rounded(t.period_growth(
        sales(s, d, "ts", "revenue"), "ts", "revenue"), 2, growth_pct=6),
    "growth_spikes": lambda s, d: rounded(t.growth_spikes(
        sales(s, d, "ts", "profit"), "ts", "profit"), 2, growth_pct=6),
    "linear_forecast": lambda s, d: rounded(t.linear_forecast(
        sales(s, d, "ts", "revenue"), "ts", "revenue"), 2),
}

_TEXTS = ["segment", "money", "units_txt", "flag", "day_txt", "constant"]
_NUM = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"
_DATE = r"'^\s*\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}'"


def _dirty_union(template: str) -> str:
    return " UNION ALL ".join(
        template.format(i=i, c=c) for i, c in enumerate(DIRTY_COLUMNS))


def _vote(i: int, c: str) -> str:
    if c in _TEXTS:
        return f"""SELECT {i} AS position, '{c}' AS "column", CAST(count({c}) AS BIGINT) AS n_present,
            count(*) FILTER (WHERE regexp_matches({c}, {_NUM})) / count({c}) AS ns,
            count(*) FILTER (WHERE regexp_matches({c}, {_DATE})
                             AND TRY_CAST({c} AS TIMESTAMP) IS NOT NULL) / count({c}) AS ds,
            bool_and(lower({c}) IN ('true','false','yes','no','1','0','t','f')) AS bools,
            avg(length({c})) AS len,
            coalesce(bool_and(TRY_CAST({c} AS DOUBLE) = floor(TRY_CAST({c} AS DOUBLE))), false) AS whole,
            CAST(count(DISTINCT {c}) AS BIGINT) AS k, false AS num FROM dirty"""
    return f"""SELECT {i} AS position, '{c}' AS "column", CAST(count({c}) AS BIGINT) AS n_present,
            1.0::DOUBLE AS ns, 0.0::DOUBLE AS ds, false AS bools, 0.0::DOUBLE AS len,
            bool_and({c} = floor({c})) AS whole, CAST(count(DISTINCT {c}) AS BIGINT) AS k,
            true AS num FROM dirty"""


_TYPED = DIRTY_WITH + "votes AS (" + " UNION ALL ".join(
    _vote(i, c) for i, c in enumerate(DIRTY_COLUMNS)) + """),
    typed AS (SELECT *, CASE WHEN n_present = 0 THEN 'categorical' WHEN num OR ns > 0.85 THEN 'numeric'
        WHEN ds > 0.8 THEN 'datetime' WHEN bools THEN 'boolean' WHEN len > 50 THEN 'text'
        ELSE 'categorical' END AS base FROM votes),
    types AS (SELECT *, base = 'numeric' AND k = 2 AND whole AS is_binary,
        CASE WHEN base = 'numeric' AND k = 2 AND whole THEN 'boolean' ELSE base END AS dtype FROM typed)"""

_NUMERIC_DIRTY = {"row_id": "row_id", "revenue": "revenue", "quantity": "quantity",
                  "units_txt": "TRY_CAST(units_txt AS DOUBLE)", "sparse": "sparse"}
_DIRTY_STATS = ", stats AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", avg(v) AS mean, median(v) AS median, stddev_samp(v) AS std,
        min(v) AS min, max(v) AS max, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3,
        CAST(count(*) FILTER (WHERE v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) AS BIGINT)
        AS outlier_count
        FROM (SELECT CAST({e} AS DOUBLE) AS v FROM dirty),
        (SELECT quantile_cont(CAST({e} AS DOUBLE), 0.25) AS a, quantile_cont(CAST({e} AS DOUBLE), 0.75) AS b
         FROM dirty)""" for c, e in _NUMERIC_DIRTY.items()) + ")"

PROFILE_SQL = _TYPED + _DIRTY_STATS + ", nulls AS (" + _dirty_union(
    """SELECT {i} AS position, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(*) - count({c}) AS BIGINT) AS null_count FROM dirty""") + """),
    prof AS (SELECT types.position, types."column",
        CASE WHEN num THEN 'number' ELSE 'text' END AS kind, dtype, is_binary, n_rows, null_count,
        null_count / n_rows AS null_rate, k AS cardinality, mean, median, std, min, max, q1, q3,
        outlier_count, "column" AS alias,
        CASE WHEN regexp_matches("column", '(^id$|_id$|^uuid|^key$|^index$|^row)') THEN 'identifier'
             WHEN dtype = 'datetime' OR regexp_matches("column", '(day|date|time)') THEN 'date'
             WHEN base = 'numeric' AND regexp_matches("column", '(revenue|quantity|units)') THEN 'quantity'
             WHEN base = 'numeric' AND k <= 10 AND n_rows > 20 THEN 'category'
             WHEN base = 'numeric' THEN 'quantity' ELSE 'category' END AS semantic_tag
        FROM types JOIN nulls USING (position) LEFT JOIN stats USING ("column"))"""

_FLAGS = PROFILE_SQL + """, flags AS (
    SELECT "column", 'outliers_detected' AS flag, 'low' AS severity FROM prof WHERE outlier_count > 0
    UNION ALL SELECT "column", 'low_variance', 'low' FROM prof WHERE mean <> 0 AND abs(std / mean) < 0.01
    UNION ALL SELECT "column", 'high_missing', CASE WHEN null_rate > 0.6 THEN 'high' ELSE 'medium' END
        FROM prof WHERE null_rate > 0.3
    UNION ALL SELECT "column", 'high_cardinality', 'low' FROM prof
        WHERE dtype = 'categorical' AND cardinality > 50)"""

_MONTHS = SALES_WITH + """months AS (SELECT strftime(ts, '%Y-%m') AS period, sum({m}) AS value
    FROM sales GROUP BY 1), numbered AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS x
    FROM months), growth AS (SELECT *, (value / nullif(lag(value) OVER (ORDER BY period), 0) - 1) * 100
    AS g FROM months)"""
_REV = _MONTHS.format(m="revenue")
_BINS = """SELECT CAST(b AS INTEGER) AS bin, round(lo + b * (hi - lo) / 10, 4) AS low,
    round(lo + (b + 1) * (hi - lo) / 10, 4) AS high,
    (SELECT CAST(count(*) AS BIGINT) FROM events WHERE least(floor((value - lo) / ((hi - lo) / 10)), 9) = b) AS n
    FROM (SELECT min(value) AS lo, max(value) AS hi FROM events), range(10) t(b)"""
_EVENT_Q = """(SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)"""

# the hundred values of events farthest beyond the fences, and how many there are
_FAR = f"""(SELECT value, n FROM (SELECT value, count(*) OVER () AS n,
    row_number() OVER (ORDER BY greatest(a - 1.5 * (b - a) - value, value - b - 1.5 * (b - a)) DESC, value) AS rank
    FROM events, {_EVENT_Q} WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) WHERE rank <= 100)"""


def _detail(source: str) -> str:
    """Column detail of events.value; fences and outliers always come from the whole table."""
    return f"""WITH low_events AS (SELECT * FROM events WHERE value < 200),
        s AS (SELECT [count(value)::DOUBLE, avg(value), median(value), stddev_samp(value), min(value),
            max(value), quantile_cont(value, 0.25), quantile_cont(value, 0.75)] AS v FROM {source}),
        bins AS ({_BINS.replace("FROM events", "FROM " + source)}),
        outliers AS (SELECT value, n, row_number() OVER (ORDER BY value) - 1 AS k FROM {_FAR})
        SELECT 'stat' AS section, CAST(i AS INTEGER) AS position,
            ['n', 'mean', 'median', 'std', 'min', 'max', 'q1', 'q3'][i + 1] AS label,
            round(v[i + 1], 4) AS value FROM s, range(8) t(i)
        UNION ALL SELECT 'presence', 0, 'null_count', count(*) - count(value)::DOUBLE FROM {source}
        UNION ALL SELECT 'presence', 1, 'null_rate', round(1 - count(value) / count(*), 4) FROM {source}
        UNION ALL SELECT 'presence', 2, 'cardinality', count(DISTINCT value)::DOUBLE FROM {source}
        UNION ALL SELECT 'outlier', -1, 'count', coalesce(max(n), 0)::DOUBLE FROM outliers
        UNION ALL SELECT 'histogram', bin, format('{{:,.2f}}', low) || ' - ' || format('{{:,.2f}}', high),
            n::DOUBLE FROM bins
        UNION ALL SELECT 'outlier', CAST(k AS INTEGER), 'value', round(value, 4) FROM outliers"""


ORACLE = {
    "null_profile": DIRTY_SQL + _dirty_union(
        """SELECT {i} AS position, '{c}' AS "column", CAST(count(*) AS BIGINT) AS n_rows,
           CAST(count(*) - count({c}) AS BIGINT) AS null_count,
           round((count(*) - count({c})) / count(*), 6) AS null_rate FROM dirty"""),
    "missing_summary": DIRTY_SQL + "SELECT * FROM (" + _dirty_union(
        """SELECT '{c}' AS "column", CAST(count(*) - count({c}) AS BIGINT) AS missing_count,
           round((count(*) - count({c})) / count(*) * 100, 6) AS missing_pct FROM dirty""")
    + ") WHERE missing_count > 0",
    "cardinality": DIRTY_SQL + _dirty_union(
        """SELECT '{c}' AS "column", CAST(count(DISTINCT {c}) AS BIGINT) AS cardinality FROM dirty"""),
    "sample_values": DIRTY_SQL + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", string_agg(CAST(v AS VARCHAR), '|' ORDER BY v) AS samples
            FROM (SELECT DISTINCT {c} AS v FROM dirty WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)"""
        for c in ("row_id", "segment", "quantity", "flag", "day_txt")),
    "infer_types": _TYPED + """ SELECT position, "column", dtype, is_binary, k AS cardinality,
        n_present, round(ns, 6) AS numeric_share, round(ds, 6) AS date_share FROM types""",
    "duplicate_count": """SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM
        (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority, year(o_orderdate),
         month(o_orderdate))""",
    "numeric_stats": SALES_SQL + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS n, round(avg({c}), 4) AS mean,
            round(median({c}), 7) AS median, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min,
            round(max({c}), 4) AS max, round(quantile_cont({c}, 0.25), 7) AS q1,
            round(quantile_cont({c}, 0.75), 7) AS q3 FROM sales""" for c in MEASURES),
    "numeric_stats_dirty": DIRTY_SQL + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(count(v) AS BIGINT) AS n, round(avg(v), 4) AS mean,
            round(median(v), 7) AS median, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min,
            round(max(v), 4) AS max, round(quantile_cont(v, 0.25), 7) AS q1,
            round(quantile_cont(v, 0.75), 7) AS q3
            FROM (SELECT TRY_CAST({c} AS DOUBLE) AS v FROM dirty)"""
        for c in ("revenue", "units_txt", "sparse")),
    "iqr_outliers": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(a - 1.5 * (b - a), 4) AS lower_fence,
            round(b + 1.5 * (b - a), 4) AS upper_fence,
            CAST((SELECT count(*) FROM events WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a))
                 AS BIGINT) AS outlier_count
            FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a,
                         quantile_cont(CAST({c} AS DOUBLE), 0.75) AS b FROM events)"""
        for c in ("value", "user_id")),
    "histogram": _BINS,
    "top_values": SALES_SQL + """SELECT brand AS value, CAST(count(*) AS BIGINT) AS n,
        round(count(*) / (SELECT count(brand) FROM sales) * 100, 6) AS pct FROM sales
        GROUP BY brand ORDER BY n DESC, brand LIMIT 20""",
    "binary_values": """SELECT CASE quality WHEN 1 THEN 'Yes' ELSE 'No' END AS value,
        CAST(count(*) AS BIGINT) AS n, round(count(*) / (SELECT count(quality) FROM labels) * 100, 6) AS pct
        FROM labels GROUP BY quality""",
    "outlier_values": f"""SELECT round(value, 4) AS v, CAST(n AS BIGINT) AS n_outliers FROM {_FAR}""",
    "column_detail": _detail("events"),
    "compare_versions": f"""SELECT *, 'raw' AS version FROM ({_detail("events")})
        UNION ALL SELECT *, 'clean' FROM ({_detail("low_events")})""",
    "profile": PROFILE_SQL + """SELECT * REPLACE (round(null_rate, 4) AS null_rate, round(mean, 4) AS mean,
        round(median, 7) AS median, round(std, 4) AS std, round(min, 4) AS min, round(max, 4) AS max,
        round(q1, 7) AS q1, round(q3, 7) AS q3) FROM prof""",
    "quality_flags": _FLAGS + "SELECT * FROM flags",
    "overview": _FLAGS + """SELECT CAST(count(*) FILTER (WHERE null_rate < 1) AS BIGINT) AS n_valid,
        (SELECT CAST(count(*) AS BIGINT) FROM flags WHERE flag = 'high_cardinality') AS n_high_cardinality,
        (SELECT CAST(count(*) AS BIGINT) FROM flags WHERE flag = 'low_variance') AS n_low_variance,
        CAST(count(*) FILTER (WHERE cardinality = 1) AS BIGINT) AS n_constant,
        round(sum(null_count) / sum(n_rows) * 100, 6) AS missing_pct,
        round(100 - sum(null_count) / sum(n_rows) * 100, 6) AS complete_pct FROM prof""",
    "summary_card": """WITH g AS (SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y,
            month(o_orderdate) AS m FROM orders)
        SELECT CAST(count(*) AS BIGINT) AS n_rows, 4::BIGINT AS n_cols, 2::BIGINT AS n_numeric,
            2::BIGINT AS n_categorical, 0::BIGINT AS n_datetime, 0::BIGINT AS n_boolean,
            0::BIGINT AS n_text, 0::BIGINT AS missing_cells, 0.0::DOUBLE AS missing_rate,
            '' AS high_missing, 'm' AS important, 'm' AS target, 'good' AS quality,
            CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM g)) AS BIGINT) AS n_duplicates
        FROM g""",
    "target_column": SALES_WITH + "candidates AS (" + " UNION ALL ".join(
        f"""SELECT {i} AS position, '{c}' AS "column", stddev_samp({c}) AS std,
            count(*) FILTER (WHERE {c} IS NULL) / count(*) AS null_rate FROM sales"""
        for i, c in enumerate(MEASURES)) + """)
        SELECT "column" FROM candidates WHERE std > 0 AND null_rate < 0.3
        ORDER BY regexp_matches("column", 'revenue|profit|sales|income|amount|total') DESC, position
        LIMIT 1""",
    "describe": DIRTY_SQL + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS n, round(avg({c}), 4) AS mean,
            round(median({c}), 7) AS median, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min,
            round(max({c}), 4) AS max, round(quantile_cont({c}, 0.25), 7) AS q1,
            round(quantile_cont({c}, 0.75), 7) AS q3, round(max({c}) - min({c}), 4) AS range,
            round(least(1, stddev_samp({c}) / abs(avg({c}))), 4) AS impact,
            round(greatest(0.5, count({c}) / count(*)), 6) AS confidence,
            CASE WHEN 1 - count({c}) / count(*) > 0.6 THEN 'high'
                 WHEN 1 - count({c}) / count(*) > 0.3 THEN 'medium' END AS warning FROM dirty"""
        for c in ("revenue", "quantity")),
    "correlation_pairs": SALES_WITH + "pairs AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, CAST(count(*) AS BIGINT) AS n FROM sales"
        for i, a in enumerate(MEASURES) for b in MEASURES[i + 1:]) + """)
        SELECT a, b, round(r, 6) AS r, n, CASE WHEN abs(r) >= 0.8 THEN 'very strong'
            WHEN abs(r) >= 0.6 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
            CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
        FROM pairs WHERE abs(r) >= 0.3 ORDER BY abs(pairs.r) DESC, a, b LIMIT 3""",
    "correlation_all": DIRTY_WITH + "pairs AS (" + " UNION ALL ".join(
        f"""SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r,
            CAST(count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS BIGINT) AS n FROM dirty"""
        for i, a in enumerate(["revenue", "quantity", "sparse", "row_id"])
        for b in ["revenue", "quantity", "sparse", "row_id"][i + 1:]) + """)
        SELECT a, b, round(r, 6) AS r, n, CASE WHEN abs(r) >= 0.8 THEN 'very strong'
            WHEN abs(r) >= 0.6 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
            CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM pairs
        WHERE r IS NOT NULL AND NOT isnan(r)""",
    "spearman": DIRTY_WITH + _spearman_sql("dirty", RANKED),
    "spearman_narrowed": SALES_WITH + _spearman_sql("sales", MEASURES),
    "correlation": SALES_SQL + """SELECT 'quantity' AS a, 'revenue' AS b, round(r, 6) AS r, n,
        CASE WHEN abs(r) >= 0.8 THEN 'very strong' WHEN abs(r) >= 0.6 THEN 'strong'
             WHEN abs(r) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
        CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM
        (SELECT corr(quantity, revenue) AS r, CAST(count(*) AS BIGINT) AS n FROM sales)""",
    "shape_stats": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS n, round(skewness({c}), 5) AS skewness,
            round(kurtosis({c}), 5) AS kurtosis,
            CASE WHEN skewness({c}) > 0 THEN 'right' ELSE 'left' END AS direction FROM events"""
        for c in ("value", "user_id")),
    "pareto": """WITH r AS (SELECT value, row_number() OVER (ORDER BY value DESC) AS k,
            sum(value) OVER (ORDER BY value DESC ROWS UNBOUNDED PRECEDING) AS c FROM events),
        t AS (SELECT CAST(count(*) AS BIGINT) AS n, sum(value) AS total FROM events)
        SELECT 'value' AS "column", n, round(total, 4) AS total,
            round((SELECT sum(value) FROM r, t WHERE k <= floor(n * 0.2)) / total * 100, 4) AS top_20_pct,
            (SELECT CAST(count(*) + 1 AS BIGINT) FROM r, t WHERE c <= total * 0.8) AS n_for_80,
            round((SELECT count(*) + 1 FROM r, t WHERE c <= total * 0.8) / n * 100, 4) AS pct_rows_for_80
        FROM t""",
    "cumulative_share": """WITH r AS (SELECT value, row_number() OVER (ORDER BY value DESC) AS k,
            sum(value) OVER (ORDER BY value DESC ROWS UNBOUNDED PRECEDING) AS c FROM events),
        t AS (SELECT count(*) AS n, sum(value) AS total FROM events)
        SELECT round(k * 100.0::DOUBLE / n, 4) AS pct_rows, round(c / total * 100, 4) AS pct_value
        FROM r, t WHERE (k - 1) % greatest(1, n // 20) = 0 OR k = n ORDER BY k""",
    "factor_influence": SALES_WITH + "num AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, corr({c}, revenue) AS r FROM sales"
        for c in ("quantity", "discount", "tax")) + "), means AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c} AS g, avg(revenue) AS m FROM sales GROUP BY {c}"
        for c in ("region", "segment", "brand")) + """),
        sd AS (SELECT stddev_samp(revenue) AS s FROM sales)
        SELECT feature, 'numeric' AS type, round(abs(r), 5) AS impact, round(r, 5) AS r,
            NULL::DOUBLE AS spread, NULL::VARCHAR AS best_group, NULL::VARCHAR AS worst_group,
            NULL::BIGINT AS n_groups FROM num
        UNION ALL SELECT feature, 'categorical', round(least(1, (max(m) - min(m)) / max(s)), 5), NULL,
            round(max(m) - min(m), 3), arg_max(g, m), arg_min(g, m), CAST(count(*) AS BIGINT)
            FROM means, sd GROUP BY feature""",
    "monthly_totals": _REV + "SELECT period, round(value, 2) AS value FROM months",
    "monthly_trend": _REV + """SELECT CAST(count(*) AS BIGINT) AS n_months,
        round(regr_slope(value, x), 2) AS slope, round(regr_intercept(value, x), 2) AS intercept,
        round(corr(value, x) ^ 2, 6) AS r_squared,
        CASE WHEN regr_slope(value, x) > 0 THEN 'upward' ELSE 'downward' END AS direction,
        arg_max(period, value) AS peak_period, round(max(value), 2) AS peak_value,
        arg_min(period, value) AS trough_period, round(min(value), 2) AS trough_value,
        round((max(value) - avg(value)) / abs(avg(value)) * 100, 2) AS peak_pct_above_mean
        FROM numbered""",
    "period_growth": _REV + """SELECT period, round(value, 2) AS value, round(g, 6) AS growth_pct,
        coalesce(g = (SELECT max(g) FROM growth), false) AS is_peak,
        coalesce(abs(g - (SELECT avg(g) FROM growth)) > 2 * (SELECT stddev_samp(g) FROM growth), false)
        AS is_spike FROM growth""",
    "growth_spikes": _MONTHS.format(m="profit") + """SELECT period, round(value, 2) AS value,
        round(g, 6) AS growth_pct FROM growth
        WHERE abs(g - (SELECT avg(g) FROM growth)) > 2 * (SELECT stddev_samp(g) FROM growth)""",
    "linear_forecast": _REV + """SELECT period, round(value, 2) AS value, 'historical' AS type FROM months
        UNION ALL SELECT strftime(max(strptime(period || '-01', '%Y-%m-%d')) + to_months(CAST(h AS INTEGER)),
            '%Y-%m'), round(regr_slope(value, x) * (count(*) + h - 1) + regr_intercept(value, x), 2),
            'forecast' FROM numbered, range(1, 4) t(h) GROUP BY h""",
}
ORACLE |= {f"{name}_narrowed": ORACLE[name] for name in ("pareto", "cumulative_share", "numeric_stats")}
