import random

import pytest

from assay import session
from assay.sources import sinks
from assay.sources.pages import page_index
from assay.sources.readers import check_shape, clean_header, read_table
from assay.sources.tables import sales


def test_csv_with_bad_rows_and_headers(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("Unnamed: 0, name ,price,\n0,a,1.5,x\n1,b,2.5,x\n2,c,3,4,5,6\n")
    df = read_table(spark, str(path))
    assert df.columns == ["name", "price"]
    assert sorted(tuple(r) for r in df.collect()) == [("a", "1.5"), ("b", "2.5")]


def test_shape_checks(frame):
    df = frame("a int, b int", [(1, 2)])
    assert check_shape(df) is df
    with pytest.raises(ValueError):
        check_shape(df.filter("a > 5"))
    with pytest.raises(ValueError):
        check_shape(df.select("a"))
    assert clean_header(df.withColumnRenamed("a", " a ")).columns == ["a", "b"]


def test_clean_table_hides_internal_columns(frame, spark, tmp_path):
    df = frame("a int, ts__year int, __flag__ int", [(1, 2, 3), (4, 5, 6)])
    sinks.write_clean(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == ["a", "ts__year"] and back.count() == 2
    sinks.write_preview(df, "a", str(tmp_path / "page"), 1)
    assert spark.read.option("header", True).csv(str(tmp_path / "page")).collect()[0]["a"] == "1"


def test_preview_pages(frame):
    df = frame("a int", [(i,) for i in range(10)])
    rows = sinks.preview(df, "a", 8, 5).collect()
    assert [(r["a"], r["total_rows"]) for r in rows] == [(8, 10), (9, 10)]


def test_sales_joins_only_what_it_needs(spark, sf_dir):
    def plan(*columns):
        return sales(spark, sf_dir, *columns)._jdf.queryExecution().optimizedPlan().toString()

    assert "Join" not in plan("revenue", "returnflag")
    assert plan("revenue", "priority").count("Join") == 1
    assert sales(spark, sf_dir).count() == sales(spark, sf_dir, "quantity").count()


def test_pages_equal_slices_of_the_sorted_table(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, float("nan"), -0.5, 1.5, 2.5]), i, f"t{i % 7}") for i in range(400)]
    df = spark.createDataFrame(rows, "a double, id int, t string").repartition(5)
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] is not None and r[0] != r[0],
                                       0 if r[0] is None or r[0] != r[0] else r[0], r[1]))
    index = page_index(df, ["a", "id"], 6)
    assert index.total == 400 and len(index.ranges) > 3
    for offset, n in ((0, 1), (57, 90), (199, 3), (360, 100), (399, 5), (400, 5), (-4, 0)):
        got = [(r["id"], r["total_rows"]) for r in index.page(offset, n).collect()]
        assert got == [(r[1], 400) for r in want[max(0, offset):max(0, offset) + max(1, n)]]
    assert page_index(df.limit(0), "id").page().collect() == []


def test_a_deep_page_sorts_one_range(spark):
    df = spark.range(0, 10_000, 1, 8).selectExpr("id AS k", "repeat('x', 20) AS text")
    index = page_index(df, "k", 20)
    page = index.page(9_300, 10)
    touched = page._jdf.queryExecution().optimizedPlan().toString()
    assert [r["k"] for r in page.collect()] == list(range(9_300, 9_310)) and "Filter" in touched
    low, high, n = next(r for r in index.ranges if r[0]["k0"] <= 9_300 <= r[1]["k0"])
    assert n < 2_000 and high["k0"] - low["k0"] + 1 == n


def test_a_table_in_one_part_is_written_for_all_cores(spark):
    def sizes(df):
        return sorted(n for n in map(len, df.rdd.glom().collect()) if n)

    df = spark.range(4000).coalesce(1)
    with session.written_tables() as made:
        even, small = session.cut_evenly(df, 500), session.cut_evenly(df)
    parts = min(8, spark.sparkContext.defaultParallelism)
    assert len(sizes(even)) == parts and max(sizes(even)) <= 2 * 4000 / parts and sizes(small) == [4000]
    assert sorted(r[0] for r in even.collect()) == list(range(4000))
    assert len(made) == 2 and all(any(path in f for f in even.inputFiles() + small.inputFiles()) for path in made)
    assert session.cut_evenly(spark.range(0)).count() == 0
