"""Reading, typing, bundles, staging and export."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillgrid import sources as src
from tillgrid.sources.schemas import Dataset, Field


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


SMALL = Dataset(
    "small",
    (
        Field("Name", "name"),
        Field("Score (5.0)", "score", "double"),
        Field("Opened", "opened", "timestamp_ntz", "lenient"),
        Field("Amount", "amount", "decimal(18,2)"),
        Field("Note", "note", optional=True),
    ),
)


def test_columns_are_found_by_header_in_any_order(spark, tmp_path):
    text = 'Extra,Score (5.0),Amount,Name,Opened\n1,4.5,10.25,"Smith, ""J""",2024-02-01\n2,NaN,NA,None,soon\n3, 7 ,,é,\n'
    df = src.read_table(spark, write(tmp_path / "a.csv", text), SMALL, date_format="yyyy-MM-dd")
    assert df.dtypes == [("name", "string"), ("score", "double"), ("opened", "timestamp_ntz"), ("amount", "decimal(18,2)")]
    assert [tuple(r) for r in df.collect()] == [
        ('Smith, "J"', 4.5, dt.datetime(2024, 2, 1), Decimal("10.25")),
        (None, None, None, None),
        ("é", 7.0, None, None),
    ]


def test_bad_number_fails_when_read(spark, tmp_path):
    path = write(tmp_path / "a.csv", "Name,Score (5.0),Opened,Amount\nx,high,2024-01-01,1\n")
    with pytest.raises(Exception, match="score is not double: high"):
        src.read_table(spark, path, SMALL).collect()


def test_amounts_are_never_rounded_unseen(spark, tmp_path):
    path = write(tmp_path / "a.csv", "Name,Score (5.0),Opened,Amount\nx,1,2024-01-01,1.005\n")
    with pytest.raises(Exception, match="amount is not decimal"):
        src.read_table(spark, path, SMALL).collect()
    assert src.read_table(spark, path, SMALL.with_money("double")).first()["amount"] == 1.005


def test_strict_date_fails_when_read(spark, tmp_path):
    path = write(tmp_path / "a.csv", "Employee ID,JoiningDate,Branch,Department,Position,Gender,Age,IncomeLevelNumeric,EducationLevel\n1,then,b,d,p,g,30,1,e\n")
    with pytest.raises(Exception, match="not a timestamp"):
        src.read_table(spark, path, src.EMPLOYEES).collect()


def test_missing_column_fails_at_once(spark, tmp_path):
    path = write(tmp_path / "a.csv", "Name,Opened\nx,2024-01-01\n")
    with pytest.raises(ValueError, match="Score"):
        src.read_table(spark, path, SMALL)


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b\n"one\ntwo",2\n')
    assert [tuple(r) for r in src.read_table(spark, path, multi_line=True).collect()] == [("one\ntwo", "2")]


def test_parquet_in(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(2).select(
        F.lit("N/A").alias("name"), F.lit(1).alias("score"), F.lit("2024-01-01").alias("Opened"), F.lit(2).alias("Amount")
    ).write.parquet(path)
    row = src.read_table(spark, path, SMALL, fmt="parquet").first()
    assert tuple(row) == (None, 1.0, dt.datetime(2024, 1, 1), Decimal("2.00"))


def test_headers_become_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["NPL Rate (%)", "Customer Satisfaction (5.0)", "monthly_volume_(ghs)"])
    got = src.normalize_headers(df, {"Customer Satisfaction (5.0)": "customer_satisfaction"})
    assert got.columns == ["npl_rate_pct", "customer_satisfaction", "monthly_volume_ghs"]
    assert got.first()["customer_satisfaction"] == 2
    with pytest.raises(ValueError, match="collide"):
        src.normalize_headers(spark.createDataFrame([(1, 2)], ["a b", "A-B"]))


def test_bundle_is_all_or_nothing(spark, tmp_path):
    ages = write(tmp_path / "ages.csv", "Age Groups,Total\n15-24,10\n")
    good = {"ages": (ages, src.INDUSTRY_AGES), "regions": (ages, None)}
    assert src.read_bundle(spark, good)["ages"].first()["total"] == 10.0
    bad = good | {"pop": (str(tmp_path / "absent.csv"), src.INDUSTRY_POPULATION)}
    with pytest.raises(Exception, match="absent"):
        src.read_bundle(spark, bad)
    empty = src.read_bundle(spark, bad, on_error="empty")
    assert {k: v.count() for k, v in empty.items()} == {"ages": 0, "regions": 0, "pop": 0}
    assert empty["pop"].columns == ["industry", "total_population"] and empty["regions"].columns == []


def test_stage_keeps_rows_and_types(spark, tmp_path, rows):
    df = spark.range(1000).select("id", (F.col("id") % 3 + 2000).cast("int").alias("y"), F.lit("x").alias("s"))
    staged = src.stage(df, str(tmp_path / "s"), "y")
    assert staged.dtypes == [("id", "bigint"), ("s", "string"), ("y", "int")]
    assert rows(staged.select("id", "y", "s")) == rows(df)
    assert src.stage(df, str(tmp_path / "t")).count() == 1000


def test_export_and_back(spark, tmp_path, rows):
    df = spark.createDataFrame([('a "b", c', 1.5), (None, None), ("é", -2.0)], "name string, v double")
    path = src.export_csv(df, str(tmp_path / "out"))
    back = src.read_table(spark, path, Dataset("d", (Field("name", "name"), Field("v", "v", "double"))))
    assert rows(back) == rows(df)


def test_inline_table(spark):
    assert src.inline_table(spark, [("a", 1)], "k string, n bigint").dtypes == [("k", "string"), ("n", "bigint")]


@pytest.mark.parametrize("dataset", [src.ACCOUNTS, src.CUSTOMERS, src.EMPLOYEES, src.BRANCHES, src.AGENTS])
def test_schemas_conform_an_empty_file(spark, tmp_path, dataset):
    path = write(tmp_path / "e.csv", ",".join(f'"{f.header}"' for f in dataset.fields) + "\n")
    df = src.read_table(spark, path, dataset)
    assert df.count() == 0
    assert [f.dataType for f in df.schema] == [f.dataType for f in dataset.schema()]
