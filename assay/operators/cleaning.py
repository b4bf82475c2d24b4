"""Cleaning with an audit trail: nothing is dropped or changed without a row saying so.

``clean`` runs the eleven steps in order. Copies are found by digests and the rows that stay are
written, again when their texts are tidy, and again when these are parsed; every other step is a
projection, and each decision (fill values, case variants, fences) comes from one aggregate for all
columns together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.exprs import col, to_number, union, unpivot
from assay.functions.hot import join_counted
from assay.functions.orderstats import LIMIT, quantile_row
from assay.operators.profiling import date_formats, kind_of, parse_date, present, row_digest, value_counts
from assay.session import cut_lineage

SPARSE = 0.80
CASE_CARDINALITY = 50
MILD, EXTREME = 1.5, 3.0
Z_LIMIT, Z_SCALE = 3.0, 0.6745

# Text that means "missing", currency signs and separators, yes/no words.
NULL_WORDS = [
    "", "nan", "none", "null", "n/a", "na", "#n/a", "#na", "-", "--", "?", "missing", "unknown",
    "undefined", "not available", "not applicable", "nil",
]
CURRENCY = r"[$£€¥₹₩₺₽,\s]+"
BOOLEAN_VALUES = {
    "true": 1, "false": 0, "yes": 1, "no": 0, "y": 1, "n": 0,
    "t": 1, "f": 0, "1": 1, "0": 0, "on": 1, "off": 0,
}

AUDIT_SCHEMA = ("step int, column string, operation string, rows_affected bigint,"
                " fill_value string")
FLAG, SEVERITY = "__outlier_flag__", "__outlier_severity__"


# --- row-level expressions (usable on any DataFrame, streaming ones too) -------------------------

def tidy(c: Column) -> Column:
    """Trimmed text with inner white space collapsed; words for "missing" become NULL."""
    text = F.btrim(F.regexp_replace(c, r"\s+", " "))
    return F.when(~F.lower(text).isin(NULL_WORDS), text)


def title_case(c: Column) -> Column:
    """Every letter that follows a non-letter in upper case, all others lower: O'Neil Smith-Jones."""
    pieces = F.split(F.lower(c), r"(?<=[^\p{L}])")
    return F.array_join(F.transform(pieces, lambda p: F.concat(
        F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def money_to_number(c: Column) -> Column:
    """Text with currency signs and thousands separators to double; the rest becomes NULL."""
    return to_number(F.regexp_replace(c, CURRENCY, ""))


def yes_no(c: Column) -> Column:
    """1 / 0 for a yes/no word, NULL for anything else."""
    pairs = F.create_map(*[F.lit(x) for kv in BOOLEAN_VALUES.items() for x in kv])
    return F.try_element_at(pairs, F.lower(c))


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])


def clean_strings(df: DataFrame, columns: list[str]) -> DataFrame:
    """Trim, collapse white space and turn null words into NULL."""
    return _replace(df, {c: tidy(col(c)) for c in columns})


def string_changes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, newly_null, changed): what ``clean_strings`` does to each column."""
    one = df.agg(*[F.struct(
        F.count_if(col(c).isNotNull() & tidy(col(c)).isNull()).alias("newly_null"),
        F.count_if(tidy(col(c)) != col(c)).alias("changed")).alias(f"c{i}")
        for i, c in enumerate(columns)])
    return unpivot(one, [(F.lit(c), F.col(f"c{i}.newly_null"), F.col(f"c{i}.changed"))
                         for i, c in enumerate(columns)], ["column", "newly_null", "changed"])


def case_variants(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, int]]:
    """Columns whose values differ only by case: name -> (distinct, distinct ignoring case).

    For columns of at most 50 distinct values (known from the profile), so the sets are small.
    """
    if not columns:
        return {}
    row = df.agg(*[F.struct(F.size(F.collect_set(col(c))).alias("exact"),
                            F.size(F.collect_set(F.lower(col(c)))).alias("folded")).alias(f"c{i}")
                   for i, c in enumerate(columns)]).first()
    return {c: (row[i]["exact"], row[i]["folded"]) for i, c in enumerate(columns)
            if row[i]["folded"] < row[i]["exact"]}


def normalise_case(df: DataFrame, columns: list[str],
                   max_values: int = CASE_CARDINALITY) -> DataFrame:
    """Title case for the columns that hold case variants of a value and few distinct values."""
    sizes = df.agg(*[F.count_distinct(col(c)) for c in columns]).first()
    few = [c for c, n in zip(columns, sizes) if n <= max_values]
    return _replace(df, {c: title_case(col(c)) for c in case_variants(df, few)})


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return _replace(df, {c: money_to_number(col(c).cast("string")) for c in columns})


def parse_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to timestamps, each column by the one format that fits it best (none fits: all NULL)."""
    found = date_formats(df, columns)
    return _replace(df, {c: parse_date(c, found[c]) if c in found else F.lit(None).cast("timestamp_ntz")
                         for c in columns})


def boolean_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of the text columns whose every present value is a yes/no word."""
    if not columns:
        return []
    row = df.agg(*[(F.count_if(col(c).isNotNull() & yes_no(col(c)).isNull()) == 0)
                   & (F.count(col(c)) > 0) for c in columns]).first()
    return [c for c, ok in zip(columns, row) if ok]


def standardise_bool(df: DataFrame, columns: list[str]) -> DataFrame:
    """Yes/no text to 1/0; a column with any other word is left alone."""
    return _replace(df, {c: yes_no(col(c)) for c in boolean_columns(df, columns)})


# --- imputation ----------------------------------------------------------------------------------

def medians(df: DataFrame, columns: list[str], limit: int = LIMIT) -> dict[str, float]:
    row = quantile_row(df, {f"m{i}": (c, 0.5) for i, c in enumerate(columns)}, limit).first()
    return {c: row[i] for i, c in enumerate(columns) if row[i] is not None}


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mode): most frequent value, the smallest among ties.

    Values are counted before any column meets in one place: each task sends one candidate.
    """
    # one value column is filled per kind; the smallest of the ties is the smallest of its kind
    best = F.min_by(F.coalesce(F.col("whole").cast("string"), F.col("real").cast("string"),
                               F.col("text")),
                    F.struct((-F.col("n")).alias("k"), "whole", "real", "text"))
    return value_counts(df, columns).groupBy("column").agg(best.alias("mode"))


def impute_median(df: DataFrame, columns: list[str], limit: int = LIMIT) -> DataFrame:
    return _replace(df, {c: F.coalesce(col(c).cast("double"), F.lit(m))
                         for c, m in medians(df, columns, limit).items()})


def impute_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    found = {r["column"]: r["mode"] for r in modes(df, columns).collect()}
    return _replace(df, {c: F.coalesce(col(c), F.lit(m).cast(types[c])) for c, m in found.items()})


# --- columns and dates ---------------------------------------------------------------------------

def drop_sparse(df: DataFrame, prof: DataFrame, share: float = SPARSE) -> DataFrame:
    """Without the columns of which more than 80 % is missing."""
    gone = [r["column"] for r in prof.filter(F.col("null_rate") > share).select("column").collect()]
    return df.drop(*gone)


def drop_duplicates(df: DataFrame, few: bool = False) -> DataFrame:
    """Without rows equal to another row in every column.

    ``few``: the caller knows that the rows have few different values (a handful of codes), so that each
    task keeps few of them; they are then grouped as they are. Otherwise the table is written once with
    an address for each row. Digests and addresses are shuffled; of rows with one digest the smallest
    address stays. The addresses that go are a written table too, so Spark knows its size: where it is
    small it is broadcast and no row moves, else rows meet it by address.
    """
    if few:
        return df.dropDuplicates()
    if "__address" in df.columns:
        raise ValueError("the column name __address is taken")
    table = cut_lineage(df.withColumn("__address", F.monotonically_increasing_id()))
    marked = table.select(row_digest(df).alias("digest"), "__address")
    first = cut_lineage(marked.groupBy("digest").agg(F.min("__address").alias("stays"), F.count("*").alias("n")).where("n > 1"))
    gone = cut_lineage(join_counted(marked, first, ["digest"], "n").where("__address > stays").select("__address"))
    return table.join(gone, "__address", "left_anti").drop("__address")


def constant_columns(df: DataFrame, exempt: list[str] = ()) -> list[str]:
    """Columns with at most one distinct present value (its smallest equals its largest)."""
    candidates = [f for f in df.schema.fields
                  if f.name not in exempt and not f.name.startswith("__")]
    if not candidates:
        return []
    row = df.agg(*[F.coalesce(F.min(present(f)) == F.max(present(f)), F.lit(True))
                   for f in candidates]).first()
    return [f.name for f, same in zip(candidates, row) if same]


def drop_constant(df: DataFrame, exempt: list[str] = ()) -> DataFrame:
    return df.drop(*constant_columns(df, exempt))


def date_parts(df: DataFrame, ts: str) -> DataFrame:
    """Year, month, month name, day, weekday name, quarter, day of year and weekend flag."""
    c = col(ts)
    parts = {
        "year": F.year(c), "month": F.month(c), "month_name": F.date_format(c, "MMMM"),
        "day": F.dayofmonth(c), "weekday": F.date_format(c, "EEEE"), "quarter": F.quarter(c),
        "day_of_year": F.dayofyear(c),
        "is_weekend": F.coalesce((F.weekday(c) >= 5).cast("int"), F.lit(0)),
    }
    return df.select("*", *[e.alias(f"{ts}__{n}") for n, e in parts.items()])


# --- outliers ------------------------------------------------------------------------------------

def mad_zscore(df: DataFrame, column: str, limit: int = LIMIT) -> DataFrame:
    """The frame with ``modified_z`` = 0.6745 (x - median) / MAD; NULL when the MAD is 0."""
    x = col(column).cast("double")
    median = quantile_row(df, {"m": (x, 0.5)}, limit).first()["m"]
    centre = F.lit(median).cast("double")
    mad = quantile_row(df, {"d": (F.abs(x - centre), 0.5)}, limit).first()["d"]
    return df.withColumn("modified_z",
                         F.try_divide(Z_SCALE * (x - centre), F.lit(mad).cast("double")))


def outlier_fences(df: DataFrame, columns: list[str], limit: int = LIMIT) -> dict[str, dict]:
    """Quartiles, median and MAD per column with four values and a positive spread."""
    if not columns:
        return {}
    row = quantile_row(df, {
        f"{q}_{i}": (c, p) for i, c in enumerate(columns)
        for q, p in (("q1", 0.25), ("med", 0.5), ("q3", 0.75))
    }, limit, also={f"n_{i}": F.count(col(c)) for i, c in enumerate(columns)}).first()
    fences = {}
    for i, c in enumerate(columns):
        if row[f"n_{i}"] >= 4 and row[f"q3_{i}"] > row[f"q1_{i}"]:
            fences[c] = {"q1": row[f"q1_{i}"], "q3": row[f"q3_{i}"], "median": row[f"med_{i}"]}
    if fences:
        spread = quantile_row(df, {
            c: (F.abs(col(c).cast("double") - F.lit(f["median"])), 0.5) for c, f in fences.items()
        }, limit).first()
        for c in fences:
            fences[c]["mad"] = spread[c]
    return fences


def outlier_tests(column: str, fence: dict) -> tuple[Column, Column]:
    """(mild, extreme): outside 1.5 spreads; outside 3 spreads or beyond 3 modified z."""
    x, spread = col(column), fence["q3"] - fence["q1"]
    mild = (x < fence["q1"] - MILD * spread) | (x > fence["q3"] + MILD * spread)
    extreme = (x < fence["q1"] - EXTREME * spread) | (x > fence["q3"] + EXTREME * spread)
    if fence["mad"] and fence["mad"] > 0:
        extreme = extreme | (F.abs(Z_SCALE * (x - fence["median"]) / fence["mad"]) > Z_LIMIT)
    return F.coalesce(mild, F.lit(False)), F.coalesce(extreme, F.lit(False))


def flag_outliers(df: DataFrame, columns: list[str], limit: int = LIMIT,
                  fences: dict[str, dict] | None = None) -> DataFrame:
    """Adds row severity (0 none, 1 mild, 2 extreme) over all columns, and a 0/1 flag."""
    fences = outlier_fences(df, columns, limit) if fences is None else fences
    levels = [F.lit(0)]
    for c, fence in fences.items():
        mild, extreme = outlier_tests(c, fence)
        levels.append(F.when(extreme, 2).when(mild, 1).otherwise(0))
    severity = F.greatest(*levels) if len(levels) > 1 else levels[0]
    return df.withColumn(SEVERITY, severity).withColumn(FLAG, (F.col(SEVERITY) > 0).cast("int"))


def outlier_counts(df: DataFrame, fences: dict[str, dict]) -> DataFrame:
    """(column, mild, extreme) value counts."""
    parts = []
    for i, (c, fence) in enumerate(fences.items()):
        mild, extreme = outlier_tests(c, fence)
        parts.append(F.struct(F.count_if(mild).alias("mild"),
                              F.count_if(extreme).alias("extreme")).alias(f"c{i}"))
    return unpivot(df.agg(*parts), [(F.lit(c), F.col(f"c{i}.mild"), F.col(f"c{i}.extreme"))
                                    for i, c in enumerate(fences)], ["column", "mild", "extreme"])


# --- the whole pipeline --------------------------------------------------------------------------

def clean(df: DataFrame, prof: DataFrame, limit: int = LIMIT,
          case_cardinality: int = CASE_CARDINALITY) -> tuple[DataFrame, DataFrame]:
    """(clean frame, audit): sparse columns, duplicates, strings, case, numbers, dates, yes/no,
    gaps, constants, date parts, outlier flags.

    Identifiers are never imputed, dropped as constant or tested for outliers; missing dates are
    counted, not filled; unusual rows are flagged, not removed. Case is repaired in columns of at
    most ``case_cardinality`` values: names and free text keep theirs.
    """
    spark, audit = df.sparkSession, []
    meta = {r["column"]: r for r in prof.collect()}
    n_raw = next(iter(meta.values()))["n_rows"]

    def log(step: int, column: str | None, operation: str, rows: int = 0, fill=None) -> None:
        audit.append((step, column, operation, int(rows), None if fill is None else str(fill)))

    # 1 sparse columns
    gone = [c for c in df.columns if meta[c]["null_rate"] > SPARSE]
    for c in gone:
        log(1, c, "column_dropped_sparse")
    kept = [c for c in df.columns if c not in gone]
    frame = df.select(*[present(f).alias(f.name) for f in df.schema.fields if f.name in kept])

    # 2 duplicates: found by digests, what stays written once
    frame = cut_lineage(drop_duplicates(frame))
    n_rows = frame.count()
    if n_raw > n_rows:
        log(2, None, "duplicate_removal", n_raw - n_rows)

    # 3 strings
    texts = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.StringType)]
    if texts:
        for r in string_changes(frame, texts).collect():
            if r["newly_null"] or r["changed"]:
                log(3, r["column"], "string_cleaning", r["newly_null"])
        frame = cut_lineage(clean_strings(frame, texts))  # tidied once, not in each of the scans below

    # 4 case
    candidates = [c for c in texts if meta[c]["dtype"] in ("categorical", "text")
                  and meta[c]["cardinality"] <= case_cardinality]
    variants = case_variants(frame, candidates)
    for c in variants:
        log(4, c, "case_normalisation")
    frame = _replace(frame, {c: title_case(col(c)) for c in variants})

    # 5 numbers, 6 dates, 7 yes/no
    numbers = [c for c in texts if meta[c]["dtype"] == "numeric"]
    if numbers:
        lost = frame.agg(*[F.count_if(col(c).isNotNull() & money_to_number(col(c)).isNull())
                           for c in numbers]).first()
        for c, n in zip(numbers, lost):
            log(5, c, "numeric_coercion", n)
        frame = coerce_numeric(frame, numbers)
    dates = [c for c in texts if meta[c]["dtype"] == "datetime"]
    for c in dates:
        log(6, c, "datetime_parsing")
    frame = parse_dates(frame, dates)
    flags = boolean_columns(frame, [c for c in texts if meta[c]["dtype"] == "boolean"])
    real = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.BooleanType)]
    if flags or real:
        counts = frame.agg(*[F.count(col(c)) for c in flags + real]).first()
        for c, n in zip(flags + real, counts):
            log(7, c, "boolean_standardisation", n)
    frame = _replace(frame, {**{c: yes_no(col(c)) for c in flags},
                             **{c: col(c).cast("int") for c in real}})
    if texts:
        frame = cut_lineage(frame)  # parsed once: all figures from here on read values of their own type

    # 8 gaps
    types = {f.name: f.dataType for f in frame.schema.fields}
    free = [c for c in kept if meta[c]["semantic_tag"] != "identifier"]
    gaps = {}
    if free:
        row = frame.agg(*[F.count_if(col(c).isNull()) for c in free]).first()
        gaps = {c: n for c, n in zip(free, row) if n}
    yes_or_no = {c for c in gaps if meta[c]["dtype"] == "boolean"}  # 0 and 1 by now, filled by their mode
    number_gaps = [c for c in gaps if isinstance(types[c], T.NumericType) and c not in yes_or_no]
    word_gaps = [c for c in gaps if c not in number_gaps
                 and meta[c]["dtype"] in ("categorical", "boolean", "text")]
    fills: dict[str, Column] = {}
    if number_gaps:
        for c, m in medians(frame, number_gaps, limit).items():
            fills[c] = F.coalesce(col(c).cast("double"), F.lit(m))
            log(8, c, "median_imputation", gaps[c], f"{m:.4g}")
    if word_gaps:
        for r in modes(frame, word_gaps).collect():
            c = r["column"]
            fills[c] = F.coalesce(col(c), F.lit(r["mode"]).cast(types[c]))
            log(8, c, "mode_imputation", gaps[c], r["mode"])
    for c in gaps:
        if kind_of(T.StructField(c, types[c])) == "time":
            log(8, c, "datetime_missing_noted", gaps[c])
    frame = _replace(frame, fills)

    # 9 constants
    identifiers = [c for c in kept if meta[c]["semantic_tag"] == "identifier"]
    constants = constant_columns(frame, identifiers)
    for c in constants:
        log(9, c, "constant_column_dropped")
    frame = frame.drop(*constants)

    # 10 date parts
    times = [f.name for f in frame.schema.fields
             if kind_of(f) == "time" and meta[f.name]["dtype"] == "datetime"]
    for c in times:
        frame = date_parts(frame, c)
        log(10, c, "date_decomposition", n_rows)

    # 11 outliers
    measured = [f.name for f in frame.schema.fields
                if isinstance(f.dataType, T.NumericType) and f.name in meta
                and meta[f.name]["semantic_tag"] != "identifier"]
    fences = outlier_fences(frame, measured, limit)
    if fences:
        for r in outlier_counts(frame, fences).collect():
            if r["mild"]:
                log(11, r["column"], "outlier_flagging", r["mild"])
            if r["extreme"]:
                log(11, r["column"], "extreme_outlier_flagging", r["extreme"])
    if measured:
        frame = flag_outliers(frame, measured, limit, fences)

    log(12, None, "rows_before", n_raw)
    log(12, None, "rows_after", n_rows)
    log(12, None, "columns_before", len(df.columns))
    log(12, None, "columns_after", len(frame.columns))
    for c in frame.columns:
        if c not in df.columns:
            log(12, c, "column_added")
    for c in gone + constants:
        log(12, c, "column_dropped")
    return frame, spark.createDataFrame(audit, AUDIT_SCHEMA)


def audit_summary(audit: DataFrame) -> DataFrame:
    """Columns touched and rows affected per operation."""
    return (
        audit.filter("step <= 11").groupBy("step", "operation")
        .agg(F.count("*").alias("n_columns"), F.sum("rows_affected").alias("rows_affected"))
        .orderBy("step", "operation")
    )


def audit_report(audit: DataFrame, raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(section, column, item, value): per-operation totals, shapes, gaps before and after."""
    def gaps(frame: DataFrame, item: str) -> DataFrame:
        fields = [f for f in frame.schema.fields if not f.name.startswith("__")]
        one = frame.agg(*[F.count_if(present(f).isNull()).alias(f"c{i}")
                          for i, f in enumerate(fields)])
        return unpivot(one, [(F.lit("missing"), F.lit(f.name), F.lit(item), F.col(f"c{i}"))
                             for i, f in enumerate(fields)], ["section", "column", "item", "value"])

    operations = audit_summary(audit).select(
        F.lit("operations").alias("section"), F.lit(None).cast("string").alias("column"),
        F.col("operation").alias("item"), F.col("rows_affected").alias("value"))
    shapes = audit.filter("step = 12 AND column IS NULL").select(
        F.lit("shape").alias("section"), "column", F.col("operation").alias("item"),
        F.col("rows_affected").alias("value"))
    steps = audit.filter("step <= 11 AND column IS NOT NULL").select(
        F.lit("columns").alias("section"), "column", F.col("operation").alias("item"),
        F.col("rows_affected").alias("value"))
    return union([operations, shapes, steps, gaps(raw, "before"), gaps(cleaned, "after")])
