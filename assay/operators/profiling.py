"""Column and dataset profiles.

All per-column figures of a kind are computed in one aggregate over the table, then turned into one
row per column. Profiles are metadata: their size is the number of columns, so ``profile`` reads
its aggregates on the driver to choose types before it asks for the figures that depend on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.exprs import (
    add_totals, clamped_ratio, col, ratio, to_number, union, unpivot)
from assay.functions.orderstats import LIMIT, quantile_row

HIGH_MISSING, VERY_HIGH_MISSING = 0.30, 0.60
HIGH_CARDINALITY = 50
LOW_VARIANCE_CV = 0.01
MIN_ROWS = 20
NUMERIC_VOTE, DATE_VOTE, TEXT_LENGTH = 0.85, 0.80, 50
FENCE = 1.5

# Words of a yes/no column, and column-name patterns of the semantic roles.
BOOLEAN_WORDS = ["true", "false", "yes", "no", "1", "0", "t", "f"]
ID_NAMES = r"(?i)(^id$|_id$|^uuid|^key$|^index$|^row)"
DATE_NAMES = r"(?i)(date|time|timestamp|month|year|day|week|quarter|period|dt|_at$|_on$)"
QUANTITY_NAMES = (
    r"(?i)(revenue|sales|amount|total|price|cost|profit|income|spend|count|qty"
    r"|quantity|volume|units|orders|value|score|rate|fee|salary|budget|expense"
    r"|bmi|risk|pollution|temp|energy|demand|inventory|visits|tickets|margin"
    r"|reading|index|consumption|satisfaction)"
)
TARGET_NAMES = r"(?i)(revenue|profit|sales|income|amount|total)"
ALIAS_DROPPED = r"[$£€%#@!?()\[\]{}]"
ALIAS_SEPARATORS = r"[\s\-./\\]+"

# Accepted date shapes, numeric or with the name of a month.
DATE_SHAPE = r"^\s*(\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|(\d{1,2}[ -])?[A-Za-z]{3,9}[ -]\d{1,4}(, ?\d{4}|[ -]\d{4})?\s*$)"
_YEAR, _MONTH, _DAY = r"\d{4,}", "0*(1[0-2]|[1-9])", r"0*([12]\d|3[01]|[1-9])"
_LONG = "(?i:january|february|march|april|may|june|july|august|september|october|november|december)"
# The formats, each with the shape of every text that it can parse (none: "iso" costs little).
# Only texts of its shape are given to a parser, because one that fails does so by a costly exception.
DATE_SHAPES = {
    "iso": None,
    "yyyy/M/d": f"^{_YEAR}/{_MONTH}/{_DAY}$", "M/d/yyyy": f"^{_MONTH}/{_DAY}/{_YEAR}$",
    "d/M/yyyy": f"^{_DAY}/{_MONTH}/{_YEAR}$", "M-d-yyyy": f"^{_MONTH}-{_DAY}-{_YEAR}$",
    "d-M-yyyy": f"^{_DAY}-{_MONTH}-{_YEAR}$", "d.M.yyyy": rf"^{_DAY}\.{_MONTH}\.{_YEAR}$",
    "MMM d, yyyy": f"^[A-Za-z]{{3,4}} {_DAY}, {_YEAR}$", "MMMM d, yyyy": f"^{_LONG} {_DAY}, {_YEAR}$",
    "d MMM yyyy": f"^{_DAY} [A-Za-z]{{3,4}} {_YEAR}$", "d MMMM yyyy": f"^{_DAY} {_LONG} {_YEAR}$",
    "d-MMM-yyyy": f"^{_DAY}-[A-Za-z]{{3,4}}-{_YEAR}$",
}
DATE_FORMATS = list(DATE_SHAPES)


def parse_date(c: str | Column, fmt: str) -> Column:
    """Text to timestamp by one of DATE_FORMATS; anything else becomes NULL."""
    text = F.trim(col(c).cast("string"))
    value = (text.try_cast("timestamp_ntz") if fmt == "iso" else F.when(
        text.rlike(DATE_SHAPES[fmt]), F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")))
    return F.when(text.rlike(DATE_SHAPE), value)


def date_formats(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The one format of each text column: the one that parses most of its values, in one scan.

    A column is written in one format, so 03/04/2024 is 3 April where other rows need the day first.
    Ties go to the format listed first. A column that no format parses has none.
    """
    if not columns:
        return {}
    row = df.agg(*[F.array(*[F.count(parse_date(c, f)) for f in DATE_FORMATS]) for c in columns]).first()
    return {c: DATE_FORMATS[n.index(max(n))] for c, n in zip(columns, row) if max(n)}


def kind_of(field: T.StructField) -> str:
    """Storage kind: number, boolean, time or text."""
    if isinstance(field.dataType, T.NumericType):
        return "number"
    if isinstance(field.dataType, T.BooleanType):
        return "boolean"
    if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "text"


def present(field: T.StructField) -> Column:
    """The column with NaN turned into NULL: there is one notion of missing."""
    c = col(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def _per_column(df: DataFrame, build) -> DataFrame:
    """One aggregate over the table, one row per column: build(field) -> {name: aggregate}."""
    fields = df.schema.fields
    parts = [build(f) for f in fields]
    one = df.agg(*[F.struct(*[a.alias(n) for n, a in p.items()]).alias(f"c{i}")
                   for i, p in enumerate(parts)])
    names = list(parts[0])
    rows = [(F.lit(i), F.lit(f.name), *[F.col(f"c{i}.{n}") for n in names])
            for i, f in enumerate(fields)]
    return unpivot(one, rows, ["position", "column", *names])


# --- missing values, cardinality, samples -------------------------------------------------------

def null_profile(df: DataFrame) -> DataFrame:
    """Missing count and rate of every column."""
    return _per_column(df, lambda f: {
        "n_rows": F.count("*"),
        "null_count": F.count_if(present(f).isNull()),
        "null_rate": F.coalesce(ratio(F.count_if(present(f).isNull()), F.count("*")), F.lit(0.0)),
    })


def missing_summary(df: DataFrame) -> DataFrame:
    """Columns with missing values, worst first, in percent of the rows."""
    return (
        null_profile(df).filter(F.col("null_count") > 0)
        .select("column", F.col("null_count").alias("missing_count"),
                (F.col("null_rate") * 100).alias("missing_pct"))
        .orderBy(F.col("missing_count").desc(), "column")
    )


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, n): every distinct present value of every column with its row count.

    Values keep their kind until they are grouped (whole numbers, doubles, everything else as
    text), so only the distinct ones are formatted. Frequent values collapse map-side.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    rows = []
    for f in fields:
        c, whole, real, text = present(f), F.lit(None), F.lit(None), F.lit(None)
        if isinstance(f.dataType, T.IntegralType):
            whole = c
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            real = c
        else:
            text = c
        rows.append((F.lit(f.name), whole.cast("bigint"), real.cast("double"), text.cast("string")))
    cells = unpivot(df, rows, ["column", "whole", "real", "text"])
    return (
        cells.filter("whole IS NOT NULL OR real IS NOT NULL OR text IS NOT NULL")
        .groupBy("column", "whole", "real", "text").agg(F.count("*").alias("n"))
    )


def cardinality(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct present values of every column; ``approx`` uses sketches instead of a shuffle."""
    if approx:
        return _per_column(df, lambda f: {"cardinality": F.approx_count_distinct(present(f))}) \
            .drop("position")
    counted = value_counts(df).groupBy("column").agg(F.count("*").alias("cardinality"))
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    return names.join(counted, "column", "left").select(
        "column", F.coalesce("cardinality", F.lit(0)).cast("bigint").alias("cardinality"))


def sample_values(df: DataFrame, n: int = 5) -> DataFrame:
    """The n smallest distinct present values of every column, as text.

    The rank filter is applied by every task before the shuffle (window group limit), so no task
    receives a whole column.
    """
    w = Window.partitionBy("column").orderBy("whole", "real", "text")
    return (
        value_counts(df).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("rank", _value_text().alias("value")))).alias("v"))
        .select("column", F.col("v.value").alias("samples"))
    )


def _value_text() -> Column:
    return F.coalesce(F.col("whole").cast("string"), F.col("real").cast("string"), F.col("text"))


def row_digest(df: DataFrame) -> Column:
    """SHA-256 over all columns: equal for rows that are equal in every column, as grouping sees it.

    Missing equals missing, NaN equals NaN, zeros of either sign are equal. Values are written with
    their lengths, so no two different rows have the same writing.
    """
    def written(f: T.StructField) -> Column:
        c, kind = col(f.name), f.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.when(c == 0, F.lit(0.0).cast(kind)).otherwise(c)
        elif isinstance(kind, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(kind, T.BinaryType):
            c = F.hex(c)
        elif isinstance(kind, (T.ArrayType, T.StructType)):
            c = F.to_json(c, {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                              "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
        text = c.cast("string")
        return F.coalesce(F.concat(F.char_length(text), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat_ws(",", *[written(f) for f in df.schema.fields]), 256))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in every column (missing equals missing).

    Only digests of 32 bytes are shuffled, never the rows.
    """
    copies = df.select(row_digest(df).alias("digest")).groupBy("digest").agg(F.count("*").alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


# --- types and roles ----------------------------------------------------------------------------

def _votes(f: T.StructField) -> dict[str, Column]:
    """Evidence for the logical type of a column."""
    kind, c = kind_of(f), present(f)
    if kind in ("number", "boolean"):
        v = c.cast("double")
        return {
            "n_rows": F.count("*"), "n_present": F.count(c), "numeric_share": F.lit(1.0), "date_share": F.lit(0.0),
            "all_boolean": F.lit(kind == "boolean"), "mean_length": F.lit(0.0),
            "all_whole": F.coalesce(F.bool_and(v == F.floor(v)), F.lit(False)),
        }
    if kind == "time":
        return {
            "n_rows": F.count("*"), "n_present": F.count(c), "numeric_share": F.lit(0.0), "date_share": F.lit(1.0),
            "all_boolean": F.lit(False), "mean_length": F.lit(0.0), "all_whole": F.lit(False),
        }
    text, v = c.cast("string"), to_number(c)
    return {
        "n_rows": F.count("*"), "n_present": F.count(c),
        "numeric_share": F.coalesce(ratio(F.count(v), F.count(c)), F.lit(0.0)),
        "date_share": F.coalesce(ratio(
            F.greatest(*[F.count(parse_date(c, f)) for f in DATE_FORMATS]), F.count(c)), F.lit(0.0)),
        "all_boolean": F.coalesce(F.bool_and(F.lower(text).isin(BOOLEAN_WORDS)), F.lit(False)),
        "mean_length": F.coalesce(F.avg(F.length(text)), F.lit(0.0)),
        "all_whole": F.coalesce(F.bool_and(v == F.floor(v)), F.lit(False)),
    }


def _dtype(kind: Column) -> Column:
    """Logical type from the votes; ``kind`` is the storage kind."""
    return (
        F.when(F.col("n_present") == 0, "categorical")
        .when(kind == "number", "numeric").when(kind == "boolean", "boolean")
        .when(kind == "time", "datetime")
        .when(F.col("numeric_share") > NUMERIC_VOTE, "numeric")
        .when(F.col("date_share") > DATE_VOTE, "datetime")
        .when(F.col("all_boolean"), "boolean")
        .when(F.col("mean_length") > TEXT_LENGTH, "text")
        .otherwise("categorical")
    )


def type_votes(df: DataFrame) -> DataFrame:
    """Storage kind, vote shares and the resulting logical type of every column: one scan."""
    kinds = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, kind_of(f))])
    return (
        _per_column(df, _votes).withColumn("kind", kinds[F.col("column")])
        .withColumn("dtype", _dtype(F.col("kind")))
    )


def infer_types(df: DataFrame) -> DataFrame:
    """Logical type of every column; two-valued whole-number columns count as boolean."""
    typed = type_votes(df).join(cardinality(df), "column")
    binary = (F.col("dtype") == "numeric") & (F.col("cardinality") == 2) & F.col("all_whole")
    return typed.select(
        "position", "column", F.when(binary, "boolean").otherwise(F.col("dtype")).alias("dtype"),
        binary.alias("is_binary"), "cardinality", "n_present", "numeric_share", "date_share")


def normalised_alias(name: Column) -> Column:
    """Search-friendly column name: lower case, symbols dropped, separators as one underscore."""
    alias = F.regexp_replace(F.lower(name), ALIAS_DROPPED, "")
    alias = F.regexp_replace(alias, ALIAS_SEPARATORS, "_")
    return F.btrim(F.regexp_replace(alias, "_+", "_"), F.lit("_"))


def semantic_tag(name: Column, dtype: Column, distinct: Column, n_rows: Column) -> Column:
    """Role of a column: identifier, date, quantity or category."""
    return (
        F.when(name.rlike(ID_NAMES), "identifier")
        .when((dtype == "datetime") | name.rlike(DATE_NAMES), "date")
        .when((dtype == "numeric") & name.rlike(QUANTITY_NAMES), "quantity")
        .when((dtype == "numeric") & (distinct <= 10) & (n_rows > 20), "category")
        .when(dtype == "numeric", "quantity")
        .otherwise("category")
    )


# --- numeric figures ----------------------------------------------------------------------------

def as_double(df: DataFrame, name: str) -> Column:
    """A column as double: text through the number pattern, NaN and nonsense as NULL."""
    f = df.schema[name]
    return to_number(name) if kind_of(f) == "text" else present(f).cast("double")


def numeric_stats(df: DataFrame, columns: list[str], limit: int = LIMIT) -> DataFrame:
    """Mean, median, std, min, max and quartiles of numeric columns with at least two values."""
    return stats_with_rows(df, columns, limit).drop("n_rows")


def stats_with_rows(df: DataFrame, columns: list[str], limit: int = LIMIT) -> DataFrame:
    """``numeric_stats`` with the number of rows of the table, from the same scan."""
    values = df.select(*[as_double(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    one = quantile_row(values, {
        f"{q}_{i}": (f"c{i}", p) for i in range(len(columns))
        for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))
    }, limit, also={
        f"s{i}": F.struct(F.count(f"c{i}").alias("n"), F.avg(f"c{i}").alias("mean"),
                          F.stddev_samp(f"c{i}").alias("std"), F.min(f"c{i}").alias("min"),
                          F.max(f"c{i}").alias("max")) for i in range(len(columns))
    } | {"n_rows": F.count("*")})
    names = ["column", "n", "mean", "median", "std", "min", "max", "q1", "q3", "n_rows"]
    rows = [(F.lit(c), F.col(f"s{i}.n"), F.col(f"s{i}.mean"), F.col(f"median_{i}"),
             F.col(f"s{i}.std"), F.col(f"s{i}.min"), F.col(f"s{i}.max"),
             F.col(f"q1_{i}"), F.col(f"q3_{i}"), F.col("n_rows")) for i, c in enumerate(columns)]
    return unpivot(one, rows, names).filter(F.col("n") >= 2)


def iqr_outliers(df: DataFrame, columns: list[str], k: float = FENCE,
                 limit: int = LIMIT) -> DataFrame:
    """Values outside quartile -/+ k times the interquartile range, per column."""
    values = df.select(*[as_double(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    q = quantile_row(values, {
        f"{q}_{i}": (f"c{i}", p) for i in range(len(columns)) for q, p in (("q1", .25), ("q3", .75))
    }, limit)
    fenced = values.withColumn("q", q.select(F.struct(*q.columns)).scalar())
    cuts = []
    for i in range(len(columns)):
        q1, q3 = F.col(f"q.q1_{i}"), F.col(f"q.q3_{i}")
        cuts.append((q1 - k * (q3 - q1), q3 + k * (q3 - q1)))
    one = fenced.agg(*[
        F.struct(F.max(lo).alias("lower"), F.max(hi).alias("upper"),
                 F.count_if((F.col(f"c{i}") < lo) | (F.col(f"c{i}") > hi)).alias("n")).alias(f"s{i}")
        for i, (lo, hi) in enumerate(cuts)
    ])
    return unpivot(one, [(F.lit(c), F.col(f"s{i}.lower"), F.col(f"s{i}.upper"), F.col(f"s{i}.n"))
                         for i, c in enumerate(columns)],
                   ["column", "lower_fence", "upper_fence", "outlier_count"])


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins with their edges and counts; empty bins included, last bin closed."""
    return histograms(df, [column], bins).drop("column")


def histograms(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Histograms of several columns in two scans: ranges, then all bin counts in one aggregate."""
    values = df.select(*[as_double(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    ranges = values.agg(*[
        F.struct(F.when(F.min(f"c{i}") < F.max(f"c{i}"), F.min(f"c{i}"))
                 .otherwise(F.min(f"c{i}") - 0.5).alias("lo"),
                 F.when(F.min(f"c{i}") < F.max(f"c{i}"), F.max(f"c{i}"))
                 .otherwise(F.max(f"c{i}") + 0.5).alias("hi")).alias(f"r{i}")
        for i in range(len(columns))
    ])
    placed = values.withColumn("r", ranges.select(F.struct(*ranges.columns)).scalar())
    for i in range(len(columns)):
        step = (F.col(f"r.r{i}.hi") - F.col(f"r.r{i}.lo")) / bins
        placed = placed.withColumn(
            f"b{i}", F.least(F.floor((F.col(f"c{i}") - F.col(f"r.r{i}.lo")) / step),
                             F.lit(bins - 1)))
    one = placed.agg(F.max("r").alias("r"), *[
        F.array(*[F.count_if(F.col(f"b{i}") == b) for b in range(bins)]).alias(f"n{i}")
        for i in range(len(columns))
    ])
    rows = []
    for i, c in enumerate(columns):
        lo, step = F.col(f"r.r{i}.lo"), (F.col(f"r.r{i}.hi") - F.col(f"r.r{i}.lo")) / bins
        rows += [(F.lit(c), F.lit(b), lo + b * step, lo + (b + 1) * step, F.col(f"n{i}")[b])
                 for b in range(bins)]
    return unpivot(one, rows, ["column", "bin", "low", "high", "n"]).filter("low IS NOT NULL")


# --- the fused profile --------------------------------------------------------------------------

PROFILE_SCHEMA = (
    "position int, column string, kind string, dtype string, base_dtype string, is_binary boolean,"
    " n_rows bigint, null_count bigint, null_rate double, cardinality bigint,"
    " mean double, median double, std double, min double, max double, q1 double, q3 double,"
    " outlier_count bigint, samples array<string>"
)


def profile(df: DataFrame, approx_distinct: bool = False, limit: int = LIMIT) -> DataFrame:
    """One row per column: type, role, missing values, cardinality, statistics, outliers, samples.

    Four passes whatever the number of columns: votes and missing values; distinct values; moments
    and quartiles of the columns found numeric; outliers against their fences.
    """
    spark = df.sparkSession
    votes = {r["column"]: r for r in type_votes(df).collect()}
    w = Window.partitionBy("column").orderBy("whole", "real", "text")
    if approx_distinct:
        distinct = {r["column"]: r["cardinality"] for r in cardinality(df, approx=True).collect()}
        samples = {r["column"]: r["samples"] for r in sample_values(df).collect()}
    else:
        distinct, samples = {}, {}
        counted = value_counts(df)
        per_column = counted.groupBy("column").agg(F.count("*").alias("cardinality"))
        first = (
            counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 5)
            .groupBy("column").agg(F.array_sort(F.collect_list(
                F.struct("rank", _value_text().alias("value")))).alias("v"))
        )
        for r in per_column.join(first, "column").collect():
            distinct[r["column"]] = r["cardinality"]
            samples[r["column"]] = [v["value"] for v in r["v"]]

    def binary(c: str) -> bool:
        v = votes[c]
        return bool(v["dtype"] == "numeric" and distinct.get(c, 0) == 2 and v["all_whole"])

    numeric = [c for c in df.columns if votes[c]["dtype"] == "numeric" and not binary(c)]
    stats, outliers = {}, {}
    if numeric:
        stats = {r["column"]: r for r in numeric_stats(df, numeric, limit).collect()}
        measured = [c for c in numeric if c in stats]
        counts = []
        for c in measured:
            q1, q3 = stats[c]["q1"], stats[c]["q3"]
            v = as_double(df, c)
            counts.append(F.count_if((v < q1 - FENCE * (q3 - q1)) | (v > q3 + FENCE * (q3 - q1)))
                          .alias(f"o{len(counts)}"))
        if counts:
            row = df.agg(*counts).first()
            outliers = {c: row[i] for i, c in enumerate(measured)}

    rows, n_rows = [], votes[df.columns[0]]["n_rows"]
    for i, c in enumerate(df.columns):
        s = stats.get(c)
        is_binary = binary(c)
        rows.append((
            i, c, votes[c]["kind"], "boolean" if is_binary else votes[c]["dtype"],
            votes[c]["dtype"], is_binary, n_rows, n_rows - votes[c]["n_present"],
            (n_rows - votes[c]["n_present"]) / n_rows if n_rows else 0.0, distinct.get(c, 0),
            *[float(s[k]) if s and s[k] is not None else None
              for k in ("mean", "median", "std", "min", "max", "q1", "q3")],
            outliers.get(c), samples.get(c, []),
        ))
    table = spark.createDataFrame(rows, PROFILE_SCHEMA)
    tag = semantic_tag(F.col("column"), F.col("base_dtype"), F.col("cardinality"), F.col("n_rows"))
    return (
        table.withColumn("alias", normalised_alias(F.col("column")))
        .withColumn("semantic_tag", tag).drop("base_dtype").coalesce(1)
    )


# --- reports over a profile (one row per column, never the data) ---------------------------------

def quality_flags(prof: DataFrame) -> DataFrame:
    """(column, flag, severity): missing values, outliers, low variance, cardinality, few rows."""
    def flag(condition: Column, name: str, severity: Column) -> DataFrame:
        return prof.filter(condition).select("column", F.lit(name).alias("flag"),
                                             severity.alias("severity"))

    variation = F.abs(F.try_divide(F.col("std"), F.col("mean")))
    small = prof.agg(F.max("n_rows").alias("n")).filter(F.col("n") < MIN_ROWS).select(
        F.lit(None).cast("string").alias("column"), F.lit("small_sample").alias("flag"),
        F.lit("medium").alias("severity"))
    return union([
        flag(F.col("outlier_count") > 0, "outliers_detected", F.lit("low")),
        flag((F.col("mean") != 0) & (variation < LOW_VARIANCE_CV), "low_variance", F.lit("low")),
        flag(F.col("null_rate") > HIGH_MISSING, "high_missing",
             F.when(F.col("null_rate") > VERY_HIGH_MISSING, "high").otherwise("medium")),
        flag((F.col("dtype") == "categorical") & (F.col("cardinality") > HIGH_CARDINALITY),
             "high_cardinality", F.lit("low")),
        small,
    ])


def overall_quality(flags: DataFrame) -> DataFrame:
    """good, fair (a medium flag) or poor (a high flag)."""
    rank = F.max(F.when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1)
                 .otherwise(0))
    return flags.agg(rank.alias("r")).select(
        F.when(F.col("r") == 2, "poor").when(F.col("r") == 1, "fair").otherwise("good")
        .alias("quality"))


def target_column(prof: DataFrame) -> DataFrame:
    """The likeliest outcome column: a varying quantity with few gaps, money-like names first."""
    return (
        prof.filter((F.col("dtype") == "numeric") & (F.col("semantic_tag") == "quantity")
                    & (F.col("null_rate") < 0.3) & (F.col("std") > 0))
        .orderBy(F.col("column").rlike(TARGET_NAMES).desc(), "position").limit(1).select("column")
    )


def ml_eligible(prof: DataFrame) -> DataFrame:
    """At least 20 rows and two numeric or two-valued columns."""
    usable = F.count_if((F.col("dtype") == "numeric") | F.col("is_binary"))
    return prof.agg(((F.max("n_rows") >= MIN_ROWS) & (usable >= 2)).alias("ml_eligible"))


def summary(df: DataFrame, prof: DataFrame) -> DataFrame:
    """The dataset in one row: size, types, missing cells, duplicates, key columns, quality."""
    def names(condition: Column) -> Column:
        found = F.collect_list(F.when(condition, F.struct("position", "column")))
        return F.concat_ws(", ", F.transform(F.array_sort(found), lambda s: s["column"]))

    def kinds(dtype: str) -> Column:
        return F.count_if(F.col("dtype") == dtype)

    cells = F.max("n_rows") * F.count("*")
    key = F.col("semantic_tag").isin("quantity", "date") & (F.col("null_rate") < 0.1)
    return (
        prof.agg(
            F.max("n_rows").alias("n_rows"), F.count("*").alias("n_cols"),
            kinds("numeric").alias("n_numeric"), kinds("categorical").alias("n_categorical"),
            kinds("datetime").alias("n_datetime"), kinds("boolean").alias("n_boolean"),
            kinds("text").alias("n_text"),
            F.sum("null_count").alias("missing_cells"),
            F.coalesce(ratio(F.sum("null_count"), cells), F.lit(0.0)).alias("missing_rate"),
            names(F.col("null_rate") > HIGH_MISSING).alias("high_missing"),
            names(key).alias("important"),
        )
        .withColumn("target", target_column(prof).scalar())
        .withColumn("quality", overall_quality(quality_flags(prof)).scalar())
        .withColumn("n_duplicates", duplicate_count(df).scalar())
    )


def overview(prof: DataFrame) -> DataFrame:
    """Completeness and counts of usable, high-cardinality, low-variance and constant columns."""
    flags = quality_flags(prof)
    counts = flags.agg(F.count_if(F.col("flag") == "high_cardinality").alias("high_cardinality"),
                       F.count_if(F.col("flag") == "low_variance").alias("low_variance"))
    return (
        prof.agg(
            F.count_if(F.col("null_rate") < 1).alias("n_valid"),
            F.count_if(F.col("cardinality") == 1).alias("n_constant"),
            (F.coalesce(ratio(F.sum("null_count"), F.sum("n_rows")), F.lit(0.0)) * 100)
            .alias("missing_pct"))
        .withColumn("flags", counts.select(F.struct(*counts.columns)).scalar())
        .select("n_valid", F.col("flags.high_cardinality").alias("n_high_cardinality"),
                F.col("flags.low_variance").alias("n_low_variance"), "n_constant", "missing_pct",
                (100 - F.col("missing_pct")).alias("complete_pct"))
    )


# --- column detail ------------------------------------------------------------------------------

def top_values(df: DataFrame, column: str, n: int = 20, binary: bool = False) -> DataFrame:
    """The n most frequent values with count and share of the present rows.

    For a 0/1 column the values read No and Yes, No first.
    """
    counts = df.filter(col(column).isNotNull()).groupBy(col(column).alias("raw")).agg(
        F.count("*").alias("n"))
    out = add_totals(counts, n_present=F.sum("n"))
    text = F.col("raw").cast("string")
    number = F.col("raw").try_cast("double") if binary else None
    label = (F.when(number == 1, "Yes").when(number == 0, "No").otherwise(text) if binary else text)
    kept = out.orderBy(F.col("n").desc(), "raw").limit(n)
    if binary:
        kept = kept.orderBy((number == 0).desc(), F.col("n").desc())
    return kept.select(label.alias("value"), "n",
                       (clamped_ratio(F.col("n"), F.col("n_present")) * 100).alias("pct"))


def outlier_values(df: DataFrame, column: str, raw: DataFrame | None = None, n: int | None = 100,
                   limit: int = LIMIT) -> DataFrame:
    """The n values farthest beyond the fences, in order, and how many there are: (v, n_outliers).

    Fences and values come from raw data. Both tails count: what is kept is farthest from its own
    fence, so one tail cannot hide the other; ``n=None`` keeps every outlier.
    """
    source = raw if raw is not None else df
    values = source.select(as_double(source, column).alias("v"))
    q = quantile_row(values, {"q1": ("v", 0.25), "q3": ("v", 0.75)}, limit)
    spread = F.col("q.q3") - F.col("q.q1")
    beyond = F.greatest(F.col("q.q1") - FENCE * spread - F.col("v"), F.col("v") - F.col("q.q3") - FENCE * spread)
    far = values.withColumn("q", q.select(F.struct("q1", "q3")).scalar()).withColumn(
        "beyond", beyond).filter("beyond > 0")
    kept = far if n is None else far.orderBy(F.desc("beyond"), "v").limit(n)
    return kept.select("v", far.agg(F.count("*")).scalar().alias("n_outliers")).orderBy("v")


def column_detail(df: DataFrame, column: str, raw: DataFrame | None = None,
                  limit: int = LIMIT) -> DataFrame:
    """(section, position, label, value) of a numeric column: statistics, gaps and cardinality,
    histogram, and the outliers with their full count."""
    stats = numeric_stats(df, [column], limit)
    names = ["n", "mean", "median", "std", "min", "max", "q1", "q3"]
    stat_rows = unpivot(stats, [(F.lit("stat"), F.lit(i), F.lit(n), F.col(n).cast("double"))
                                for i, n in enumerate(names)],
                        ["section", "position", "label", "value"])
    bins = histogram(df, column).select(
        F.lit("histogram").alias("section"), F.col("bin").alias("position"),
        F.concat(F.format_number("low", 2), F.lit(" - "), F.format_number("high", 2)).alias("label"),
        F.col("n").cast("double").alias("value"))
    w = Window.partitionBy(F.lit(1)).orderBy("v")  # at most 100 rows
    found = outlier_values(df, column, raw, limit=limit)
    outliers = found.select(
        F.lit("outlier").alias("section"), (F.row_number().over(w) - 1).alias("position"),
        F.lit("value").alias("label"), F.col("v").alias("value"))
    gaps = df.agg(F.count("*").alias("n_rows"), F.count(col(column)).alias("n"), F.count_distinct(col(column)).alias("d"))
    gap_rows = unpivot(gaps, [
        (F.lit("presence"), F.lit(0), F.lit("null_count"), (F.col("n_rows") - F.col("n")).cast("double")),
        (F.lit("presence"), F.lit(1), F.lit("null_rate"), ratio(F.col("n_rows") - F.col("n"), F.col("n_rows"))),
        (F.lit("presence"), F.lit(2), F.lit("cardinality"), F.col("d").cast("double")),
    ], ["section", "position", "label", "value"])
    total = found.agg(F.coalesce(F.max("n_outliers"), F.lit(0)).cast("double").alias("value")).select(
        F.lit("outlier").alias("section"), F.lit(-1).alias("position"), F.lit("count").alias("label"), "value")
    return union([stat_rows, gap_rows, bins, total, outliers])


def compare_versions(raw: DataFrame, clean: DataFrame, column: str,
                     limit: int = LIMIT) -> DataFrame:
    """Column detail before and after cleaning, one ``version`` each."""
    return union([
        column_detail(raw, column, raw, limit).withColumn("version", F.lit("raw")),
        column_detail(clean, column, raw, limit).withColumn("version", F.lit("clean")),
    ])
