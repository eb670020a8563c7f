"""Facts that hold whatever the data."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from tillgrid import operators as op

RELAXED = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
TABLE = hs.lists(
    hs.tuples(
        hs.one_of(hs.none(), hs.sampled_from("abcd")),
        hs.one_of(hs.none(), hs.integers(-50, 50).map(float)),
        hs.integers(0, 5),
    ),
    min_size=1,
    max_size=40,
)


def frame(spark, data):
    return spark.createDataFrame(data, "k string, v double, i int")


@RELAXED
@given(TABLE)
def test_counts_sum_to_known_rows_and_shares_to_a_hundred(spark, data):
    df = frame(spark, data)
    known = sum(k is not None for k, _, _ in data)
    rows = op.value_shares(df, "k").collect()
    assert sum(r.n for r in rows) == known
    if known:
        assert sum(r.share for r in rows) == pytest.approx(100)


@RELAXED
@given(TABLE, hs.integers(1, 9))
def test_histogram_counts_every_known_row(spark, data, bins):
    known = sum(v is not None for _, v, _ in data)
    rows = op.histogram(frame(spark, data), "v", bins).collect()
    assert len(rows) == bins and sum(r.n for r in rows) == known


@RELAXED
@given(TABLE)
def test_left_join_keeps_every_row(spark, data):
    dim = spark.createDataFrame([("a", 1), ("b", 2)], "name string, x int")
    for bounded in (True, False):
        assert op.join_dim(frame(spark, data), dim, "k", "name", bounded).count() == len(data)


@RELAXED
@given(TABLE, hs.integers(1, 6))
def test_top_rows_are_a_prefix_of_the_sort(spark, data, k):
    df = frame(spark, data).withColumn("id", F.monotonically_increasing_id())
    whole = [tuple(r) for r in op.order_desc(df, "v", "id").collect()]
    assert [tuple(r) for r in op.top_k(df, "v", k, "id").collect()] == whole[:k]


@RELAXED
@given(TABLE)
def test_correlation_matrix_is_symmetric(spark, data):
    df = frame(spark, data).withColumn("w", F.col("v") * F.col("i"))
    got = {(r.col_a, r.col_b): r["corr"] for r in op.corr_matrix(df, ["v", "w", "i"]).collect()}
    assert len(got) == 9
    for (a, b), r in got.items():
        assert r == got[(b, a)]
        assert r is None or (abs(r) <= 1 + 1e-9 and (a != b or r == 1.0))


@RELAXED
@given(hs.dictionaries(hs.tuples(hs.sampled_from("ab"), hs.sampled_from("xy")), hs.integers(1, 9).map(float), min_size=1))
def test_melt_undoes_a_pivot(spark, cells):
    df = spark.createDataFrame([(k, t, v) for (k, t), v in cells.items()], "k string, t string, v double")
    wide = op.mean_pivot(df, "k", "t", "v", ["x", "y"])
    back = op.drop_null(op.melt(wide, "k", "t", "v"), "v")
    assert {(r.k, r.t): r.v for r in back.collect()} == cells
