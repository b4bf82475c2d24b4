import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.operators import profiling as p


def one(df, key, value):
    return {r[key]: r for r in df.collect()}[value]


def test_type_votes_at_their_edges(frame):
    rows = []
    for i in range(100):
        rows.append((
            "x" if i < 15 else str(i),                       # 85 % numbers: not numeric
            "x" if i < 14 else f"{i}.5",                     # 86 %: numeric
            "no" if i < 20 else "2024-01-05",                # 80 % dates: not datetime
            "no" if i < 19 else "2024-01-05",                # 81 %: datetime
            ["Yes", "no", "T"][i % 3],                       # yes/no words
            "a" * 51, "a" * 50, None, ["1", "2"][i % 2]))
    names = "n85 n86 d80 d81 flag long medium empty two".split()
    df = frame(", ".join(f"{n} string" for n in names), rows)
    types = {r["column"]: r["dtype"] for r in p.infer_types(df).collect()}
    assert types == {"n85": "categorical", "n86": "numeric", "d80": "categorical", "d81": "datetime",
                     "flag": "boolean", "long": "text", "medium": "categorical",
                     "empty": "categorical", "two": "boolean"}


def test_numbers_with_trailing_letters_do_not_count(frame):
    df = frame("t string", [("12d",), ("1e3",), (" 7 ",), ("1,5",), ("-.5",), ("nan",)])
    from assay.functions.exprs import to_number
    assert [r[0] for r in df.select(to_number("t")).collect()] == [None, 1000.0, 7.0, None, -0.5, None]


def test_binary_needs_whole_numbers(frame):
    df = frame("a double, b double, c int, d boolean",
               [(0.0, 0.5, 3, True), (1.0, 1.5, 7, False)] * 10)
    types = {r["column"]: r["dtype"] for r in p.infer_types(df).collect()}
    assert types == {"a": "boolean", "b": "numeric", "c": "boolean", "d": "boolean"}


def test_missing_flags_at_their_edges(frame):
    rates = {"a": 30, "b": 31, "c": 60, "d": 61}
    rows = [tuple(None if i < n else float(i) for n in rates.values()) for i in range(100)]
    prof = p.profile(frame("a double, b double, c double, d double", rows))
    flags = {(r["column"], r["flag"]): r["severity"] for r in p.quality_flags(prof).collect()}
    assert flags == {("b", "high_missing"): "medium", ("c", "high_missing"): "medium",
                     ("d", "high_missing"): "high"}
    assert p.overall_quality(p.quality_flags(prof)).first()["quality"] == "poor"


def test_small_sample_and_low_variance(frame):
    prof = p.profile(frame("price double, k string", [(100 + i / 100, "x") for i in range(19)]))
    flags = {(r["column"], r["flag"]) for r in p.quality_flags(prof).collect()}
    assert flags == {("price", "low_variance"), (None, "small_sample")}
    assert not p.ml_eligible(prof).first()["ml_eligible"]


def test_aliases_and_roles(spark):
    rows = [("Revenue($)", "numeric", 50), ("Avg-Cost / day", "numeric", 50), ("customer_id", "numeric", 9),
            ("level", "numeric", 10), ("level2", "numeric", 11), ("created_at", "categorical", 3),
            ("note", "text", 3)]
    df = spark.createDataFrame(rows, "name string, dtype string, k bigint")
    got = df.select("name", p.normalised_alias(F.col("name")).alias("alias"),
                    p.semantic_tag(F.col("name"), F.col("dtype"), F.col("k"), F.lit(100)).alias("tag"))
    assert [(r["alias"], r["tag"]) for r in got.collect()] == [
        ("revenue", "quantity"), ("avg_cost_day", "date"), ("customer_id", "identifier"),
        ("level", "category"), ("level2", "quantity"), ("created_at", "date"), ("note", "category")]


def test_nan_is_missing(frame):
    df = frame("v double", [(float("nan"),), (None,), (1.5,), (3.0,)])
    row = p.profile(df).first()
    assert row["null_count"] == 2 and row["cardinality"] == 2 and row["mean"] == 2.25


def test_profile_statistics(frame):
    values = [float(v) for v in range(1, 21)] + [100.0]
    row = p.profile(frame("v double, w int", [(v, 1) for v in values])).first()
    assert row["median"] == np.median(values) and row["std"] == pytest.approx(np.std(values, ddof=1))
    assert row["outlier_count"] == 1 and row["samples"] == ["1.0", "2.0", "3.0", "4.0", "5.0"]


def test_histogram_closes_last_bin_and_keeps_empty_ones(frame):
    values = [0.0, 0.1, 5.0, 10.0, 10.0]
    rows = p.histogram(frame("v double", [(v,) for v in values]), "v").orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=10)
    assert [r["n"] for r in rows] == list(counts)
    assert np.allclose([r["low"] for r in rows], edges[:-1])


def test_histogram_of_one_value(frame):
    rows = p.histogram(frame("v double", [(4.0,)] * 3), "v").orderBy("bin").collect()
    counts, edges = np.histogram([4.0] * 3, bins=10)
    assert [r["n"] for r in rows] == list(counts) and rows[0]["low"] == edges[0]


def test_duplicates_treat_missing_as_equal(frame):
    df = frame("a int, b string", [(1, None), (1, None), (1, "x"), (2, None), (1, None)])
    assert p.duplicate_count(df).first()[0] == 2


def test_binary_labels_put_no_first(frame):
    df = frame("v int", [(1,)] * 5 + [(0,)] * 2 + [(None,)])
    rows = p.top_values(df, "v", binary=True).collect()
    assert [(r["value"], r["n"]) for r in rows] == [("No", 2), ("Yes", 5)]
    assert rows[1]["pct"] == pytest.approx(500 / 7)


def test_target_prefers_money_names(frame):
    prof = p.profile(frame("height double, total_sales double, row_no double",
                           [(float(i), float(i * 2), float(i)) for i in range(30)]))
    assert p.target_column(prof).first()["column"] == "total_sales"


def test_compare_versions(frame):
    raw = frame("v double", [(float(i),) for i in range(20)] + [(500.0,)])
    clean = raw.filter("v < 500")
    rows = p.compare_versions(raw, clean, "v").collect()
    assert {r["version"] for r in rows if r["section"] == "outlier"} == {"raw", "clean"}
    assert {r["value"] for r in rows if r["label"] == "max"} == {500.0, 19.0}


def test_outliers_of_both_tails_and_their_count(frame):
    rows = [(float(i % 20 + 100),) for i in range(2000)] + [(float(-i),) for i in range(150)] + [(900.0 + i,) for i in range(5)]
    out = p.outlier_values(frame("v double", rows), "v").collect()
    assert len(out) == 100 and {r["n_outliers"] for r in out} == {155}
    assert sum(r["v"] > 0 for r in out) == 5 and [r["v"] for r in out] == sorted(r["v"] for r in out)
    assert p.outlier_values(frame("v double", rows), "v", n=None).count() == 155


def test_date_parsers_see_only_texts_of_their_shape(frame):
    """A parser that fails throws, which costs more than the scan; shapes keep all that can be parsed."""
    parts = ["1", "01", "0", "13", "31", "32", "2020", "02020", "20"]
    names = ["Jan", "may", "March", "MARCH", "Foo"]
    texts = [s.join((a, b, c)) for s in "/-." for a in parts for b in parts for c in parts]
    texts += [t for n in names for d in parts for y in parts for t in (f"{n} {d}, {y}", f" {d} {n} {y}", f"{d}-{n}-{y} ")]
    df = frame("t string", [(t,) for t in [*texts, "1/2/2020x", "x", "", None]])
    text = F.trim("t")
    for fmt in p.DATE_FORMATS[1:]:
        free = F.when(text.rlike(p.DATE_SHAPE), F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz"))
        fits, found = text.rlike(p.DATE_SHAPES[fmt]), p.parse_date("t", fmt)
        r = df.agg(F.count_if(~free.eqNullSafe(found)), F.count(found), F.count_if(fits)).first()
        assert r[0] == 0 and 0 < r[1] <= r[2] < len(texts) / 5
