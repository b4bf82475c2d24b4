"""Registered queries: cleaning over the planted-defect table."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import cleaning as c
from assay.operators import profiling as p
from assay.plans.helpers import once, rounded
from assay.plans.stat_queries import DIRTY_SQL, DIRTY_WITH
from assay.session import cut_evenly
from assay.sources.tables import dirty_sales, table


@once
def _audit(spark, sf_dir):
    raw = cut_evenly(dirty_sales(spark, sf_dir))
    return c.clean(raw, p.profile(raw))


def _case_counts(spark, sf_dir):
    tidy = c.clean_strings(dirty_sales(spark, sf_dir, "segment"), ["segment"])
    return c.normalise_case(tidy, ["segment"]).groupBy("segment").agg(F.count("*").alias("n"))


def _outliers(spark, sf_dir):
    flagged = c.flag_outliers(table(spark, sf_dir, "events").select("event_id", "value"), ["value"])
    return flagged.groupBy(F.col(c.SEVERITY).alias("severity"), F.col(c.FLAG).alias("flag")).agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


QUERIES = {
    "clean_strings": lambda s, d: c.clean_strings(
        dirty_sales(s, d, "row_id", "segment"), ["segment"]),
    "string_changes": lambda s, d: c.string_changes(
        dirty_sales(s, d, "segment", "flag", "day_txt"), ["segment", "flag", "day_txt"]),
    "normalise_case": _case_counts,
    "coerce_numeric": lambda s, d: c.coerce_numeric(
        dirty_sales(s, d, "row_id", "money", "units_txt"), ["money", "units_txt"]),
    "parse_dates": lambda s, d: c.parse_dates(
        dirty_sales(s, d, "row_id", "day_txt"), ["day_txt"]),
    "standardise_bool": lambda s, d: c.standardise_bool(
        dirty_sales(s, d, "row_id", "flag", "units_txt"), ["flag", "units_txt"]),
    "impute_median": lambda s, d: rounded(c.impute_median(
        dirty_sales(s, d, "row_id", "revenue", "quantity"), ["revenue", "quantity"]), 4),
    "impute_mode": lambda s, d: c.impute_mode(c.clean_strings(
        dirty_sales(s, d, "row_id", "segment"), ["segment"]), ["segment"]),
    "modes": lambda s, d: c.modes(c.clean_strings(
        dirty_sales(s, d, "segment", "flag", "units_txt"), ["segment"]),
        ["segment", "flag", "units_txt"]),
    "drop_duplicates": lambda s, d: c.drop_duplicates(table(s, d, "orders").select(
        "o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("y")), few=True),
    "drop_duplicates_wide": lambda s, d: c.drop_duplicates(table(s, d, "documents").select("lang", "source", "text")),
    "drop_sparse": lambda s, d: _drop_sparse(s, d),
    "drop_constant": lambda s, d: rounded(c.drop_constant(
        dirty_sales(s, d, "row_id", "flag", "constant"))),
    "date_parts": lambda s, d: c.date_parts(table(s, d, "events").select("event_id", "ts"), "ts"),
    "flag_outliers": _outliers,
    "mad_zscore": lambda s, d: rounded(c.mad_zscore(
        table(s, d, "events").select("event_id", "value"), "value"), 4),
    "clean_audit": lambda s, d: _audit(s, d)[1].filter("step <= 11"),
    "audit_summary": lambda s, d: c.audit_summary(_audit(s, d)[1]),
    "audit_report": lambda s, d: _report(s, d),
    "clean_rows": lambda s, d: rounded(_audit(s, d)[0], 4),
}


def _drop_sparse(spark, sf_dir):
    raw = dirty_sales(spark, sf_dir, "row_id", "sparse", "flag")
    return c.drop_sparse(raw, p.null_profile(raw))


def _report(spark, sf_dir):
    cleaned, audit = _audit(spark, sf_dir)
    return c.audit_report(audit, dirty_sales(spark, sf_dir), cleaned)


_TIDY = """tidy AS (SELECT * REPLACE (CASE WHEN lower(trim(regexp_replace(segment, '\\s+', ' ', 'g')))
    NOT IN ('n/a', '') THEN trim(regexp_replace(segment, '\\s+', ' ', 'g')) END AS segment) FROM dirty)"""

# the cleaned table written out step by step for the planted defects
_NULLED = DIRTY_WITH + """tidy AS (SELECT row_id,
        CASE WHEN trim(segment) <> 'n/a' THEN trim(segment) END AS segment, revenue, quantity, money,
        TRY_CAST(units_txt AS DOUBLE) AS units_txt, CASE lower(flag) WHEN 'yes' THEN 1 ELSE 0 END AS flag,
        TRY_CAST(day_txt AS TIMESTAMP) AS day_txt FROM (SELECT DISTINCT * FROM dirty)),
    cased AS (SELECT * REPLACE (upper(segment[1]) || lower(segment[2:]) AS segment) FROM tidy),
    fill AS (SELECT median(revenue) AS r, median(quantity) AS q, median(units_txt) AS u,
        (SELECT segment FROM cased WHERE segment IS NOT NULL GROUP BY segment
         ORDER BY count(*) DESC, segment LIMIT 1) AS s FROM cased),
    filled AS (SELECT row_id, coalesce(segment, s) AS segment, coalesce(revenue, r) AS revenue,
        coalesce(quantity, q) AS quantity, money, coalesce(units_txt, u) AS units_txt, flag, day_txt
        FROM cased, fill),
    fences AS (SELECT quantile_cont(revenue, 0.25) AS a, quantile_cont(revenue, 0.75) AS b,
        median(revenue) AS m FROM filled),
    spread AS (SELECT a, b, m, (SELECT median(abs(revenue - m)) FROM filled, fences) AS mad FROM fences)"""
_EXTREME = "(revenue < a - 3 * (b - a) OR revenue > b + 3 * (b - a) OR abs(0.6745 * (revenue - m) / mad) > 3)"
_MILD = "(revenue < a - 1.5 * (b - a) OR revenue > b + 1.5 * (b - a))"

ORACLE = {
    "clean_strings": DIRTY_WITH + _TIDY + "SELECT row_id, segment FROM tidy",
    "string_changes": DIRTY_SQL + """
        SELECT 'segment' AS "column",
            CAST(count(*) FILTER (WHERE trim(segment) = 'n/a') AS BIGINT) AS newly_null,
            CAST(count(*) FILTER (WHERE trim(segment) <> 'n/a' AND trim(segment) <> segment) AS BIGINT)
            AS changed FROM dirty
        UNION ALL SELECT 'flag', 0, 0 UNION ALL SELECT 'day_txt', 0, 0""",
    "normalise_case": DIRTY_WITH + _TIDY + """SELECT upper(segment[1]) || lower(segment[2:]) AS segment,
        CAST(count(*) AS BIGINT) AS n FROM tidy GROUP BY 1""",
    "coerce_numeric": DIRTY_SQL + """SELECT row_id, CAST(replace(money, '$', '') AS DOUBLE) AS money,
        TRY_CAST(units_txt AS DOUBLE) AS units_txt FROM dirty""",
    "parse_dates": DIRTY_SQL + "SELECT row_id, TRY_CAST(day_txt AS TIMESTAMP) AS day_txt FROM dirty",
    "standardise_bool": DIRTY_SQL + """SELECT row_id, CASE lower(flag) WHEN 'yes' THEN 1 ELSE 0 END AS flag,
        units_txt FROM dirty""",
    "impute_median": DIRTY_WITH + """m AS (SELECT median(revenue) AS r, median(quantity) AS q FROM dirty)
        SELECT row_id, round(coalesce(revenue, r), 4) AS revenue,
               round(coalesce(quantity, q), 4) AS quantity FROM dirty, m""",
    "impute_mode": DIRTY_WITH + _TIDY + """, m AS (SELECT segment AS s FROM tidy WHERE segment IS NOT NULL
        GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)
        SELECT row_id, coalesce(segment, s) AS segment FROM tidy, m""",
    "modes": DIRTY_WITH + _TIDY + ", " + ", ".join(
        f"""m_{x} AS (SELECT '{x}' AS "column", {x} AS mode FROM tidy WHERE {x} IS NOT NULL
            GROUP BY {x} ORDER BY count(*) DESC, {x} LIMIT 1)"""
        for x in ("segment", "flag", "units_txt"))
    + " SELECT * FROM m_segment UNION ALL SELECT * FROM m_flag UNION ALL SELECT * FROM m_units_txt",
    "drop_duplicates": """SELECT DISTINCT o_orderstatus, o_orderpriority,
        CAST(year(o_orderdate) AS INTEGER) AS y FROM orders""",
    "drop_duplicates_wide": "SELECT DISTINCT lang, source, text FROM documents",
    "drop_sparse": DIRTY_SQL + "SELECT row_id, flag FROM dirty",
    "drop_constant": DIRTY_SQL + "SELECT row_id, flag FROM dirty",
    "date_parts": """SELECT event_id, ts, CAST(year(ts) AS INTEGER) AS ts__year,
        CAST(month(ts) AS INTEGER) AS ts__month, monthname(ts) AS ts__month_name,
        CAST(day(ts) AS INTEGER) AS ts__day, dayname(ts) AS ts__weekday,
        CAST(quarter(ts) AS INTEGER) AS ts__quarter, CAST(dayofyear(ts) AS INTEGER) AS ts__day_of_year,
        CAST(isodow(ts) >= 6 AS INTEGER) AS ts__is_weekend FROM events""",
    "flag_outliers": """WITH f AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b,
            median(value) AS m FROM events),
        d AS (SELECT median(abs(value - m)) AS mad FROM events, f),
        s AS (SELECT value, CASE WHEN value < a - 3 * (b - a) OR value > b + 3 * (b - a)
                OR abs(0.6745 * (value - m) / mad) > 3 THEN 2
                WHEN value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) THEN 1 ELSE 0 END AS severity
              FROM events, f, d)
        SELECT severity, CAST(severity > 0 AS INTEGER) AS flag, CAST(count(*) AS BIGINT) AS n,
               min(value) AS low, max(value) AS high FROM s GROUP BY severity""",
    "mad_zscore": """WITH f AS (SELECT median(value) AS m FROM events),
        d AS (SELECT median(abs(value - m)) AS mad FROM events, f)
        SELECT event_id, round(value, 4) AS value, round(0.6745 * (value - m) / mad, 4) AS modified_z
        FROM events, f, d""",
    "clean_audit": _NULLED + f""", counts AS (SELECT
            (SELECT count(*) FROM dirty) - (SELECT count(*) FROM cased) AS dups,
            (SELECT count(*) FROM cased WHERE segment IS NULL) AS seg,
            (SELECT count(*) FROM cased WHERE revenue IS NULL) AS rev,
            (SELECT count(*) FROM cased WHERE quantity IS NULL) AS qty,
            (SELECT count(*) FROM cased WHERE units_txt IS NULL) AS units,
            (SELECT count(*) FROM cased WHERE day_txt IS NULL) AS days,
            (SELECT count(*) FROM cased) AS n,
            (SELECT count(*) FROM filled, spread WHERE {_MILD}) AS mild,
            (SELECT count(*) FROM filled, spread WHERE {_EXTREME}) AS extreme),
        rows AS (
        SELECT 1 AS step, 'sparse' AS "column", 'column_dropped_sparse' AS operation,
               0 AS rows_affected, NULL AS fill_value
        UNION ALL SELECT 2, NULL, 'duplicate_removal', dups, NULL FROM counts WHERE dups > 0
        UNION ALL SELECT 3, 'segment', 'string_cleaning', seg, NULL FROM counts
        UNION ALL SELECT 4, 'segment', 'case_normalisation', 0, NULL
        UNION ALL SELECT 5, 'units_txt', 'numeric_coercion', units, NULL FROM counts
        UNION ALL SELECT 6, 'day_txt', 'datetime_parsing', 0, NULL
        UNION ALL SELECT 7, 'flag', 'boolean_standardisation', n, NULL FROM counts
        UNION ALL SELECT 8, 'revenue', 'median_imputation', rev, format('{{:.4g}}', r) FROM counts, fill
        UNION ALL SELECT 8, 'quantity', 'median_imputation', qty, format('{{:.4g}}', q) FROM counts, fill
        UNION ALL SELECT 8, 'units_txt', 'median_imputation', units, format('{{:.4g}}', u) FROM counts, fill
        UNION ALL SELECT 8, 'segment', 'mode_imputation', seg, s FROM counts, fill
        UNION ALL SELECT 8, 'day_txt', 'datetime_missing_noted', days, NULL FROM counts
        UNION ALL SELECT 9, 'constant', 'constant_column_dropped', 0, NULL
        UNION ALL SELECT 10, 'day_txt', 'date_decomposition', n, NULL FROM counts
        UNION ALL SELECT 11, 'revenue', 'outlier_flagging', mild, NULL FROM counts WHERE mild > 0
        UNION ALL SELECT 11, 'revenue', 'extreme_outlier_flagging', extreme, NULL FROM counts
            WHERE mild > 0 AND extreme > 0)
        SELECT CAST(step AS INTEGER) AS step, "column", operation,
               CAST(rows_affected AS BIGINT) AS rows_affected, fill_value FROM rows""",
    "clean_rows": _NULLED + f"""SELECT row_id, segment, round(revenue, 4) AS revenue, quantity, money,
        units_txt, flag, day_txt, CAST(year(day_txt) AS INTEGER) AS day_txt__year,
        CAST(month(day_txt) AS INTEGER) AS day_txt__month, monthname(day_txt) AS day_txt__month_name,
        CAST(day(day_txt) AS INTEGER) AS day_txt__day, dayname(day_txt) AS day_txt__weekday,
        CAST(quarter(day_txt) AS INTEGER) AS day_txt__quarter,
        CAST(dayofyear(day_txt) AS INTEGER) AS day_txt__day_of_year,
        CAST(coalesce(isodow(day_txt) >= 6, false) AS INTEGER) AS day_txt__is_weekend,
        CASE WHEN {_EXTREME} THEN 2 WHEN {_MILD} THEN 1 ELSE 0 END AS __outlier_severity__,
        CASE WHEN {_EXTREME} OR {_MILD} THEN 1 ELSE 0 END AS __outlier_flag__ FROM filled, spread""",
}

ORACLE["audit_summary"] = f"""SELECT step, operation, CAST(count(*) AS BIGINT) AS n_columns,
    CAST(sum(rows_affected) AS BIGINT) AS rows_affected FROM ({ORACLE["clean_audit"]}) GROUP BY ALL"""
