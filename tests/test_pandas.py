"""Operators against plain pandas and numpy on random frames with nulls, ties and zeros."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillgrid import functions as fn
from tillgrid import operators as op


@pytest.fixture(scope="module", params=[1, 2, 3])
def pdf(request):
    rng = np.random.default_rng(request.param)
    n = 400

    def holes(values, share=0.1):
        return [None if rng.random() < share else v for v in values]

    return pd.DataFrame(
        {
            "k": holes(rng.choice(["a", "b", "c", "d"], n, p=[0.6, 0.2, 0.15, 0.05]).tolist()),
            "t": holes(rng.choice(["x", "y"], n).tolist()),
            "v": pd.array(holes(np.round(rng.normal(100, 40, n), 2).tolist()), dtype="object"),
            "w": pd.array(holes(rng.integers(0, 6, n).astype(float).tolist()), dtype="object"),
            "id": [f"i{x}" for x in rng.integers(0, 300, n)],
        }
    ).astype({"v": float, "w": float})


@pytest.fixture(scope="module")
def sdf(spark, pdf):
    records = [tuple(None if pd.isna(x) else x for x in row) for row in pdf.itertuples(index=False)]
    return spark.createDataFrame(records, "k string, t string, v double, w double, id string").repartition(5)


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_counts_and_shares(sdf, pdf):
    assert as_dict(op.value_counts(sdf, "k"), "k", "n") == pdf["k"].value_counts().to_dict()
    want = (pdf["k"].value_counts(normalize=True) * 100).to_dict()
    assert as_dict(op.value_shares(sdf, "k"), "k", "share") == pytest.approx(want)


def test_counts_of_two_keys(sdf, pdf):
    got = {(r.k, r.t): r.n for r in op.value_counts(sdf, ["k", "t"]).collect()}
    assert got == pdf.groupby(["k", "t"]).size().to_dict()


def test_profile_counts(sdf, pdf):
    got = {(r.dimension, r.value): r.n for r in op.profile_counts(sdf, ["k", "t"]).collect()}
    assert got == {(c, v): n for c in ("k", "t") for v, n in pdf[c].value_counts().items()}


def test_flag_matrix(sdf, pdf):
    want = pdf[["k", "t"]].apply(lambda c: c.value_counts()).T.fillna(0)
    got = op.flag_matrix(sdf, ["k", "t"]).toPandas().set_index("flag")
    assert got.loc[["k", "t"], sorted(want.columns)].to_numpy().tolist() == want[sorted(want.columns)].to_numpy().tolist()


def test_sums_and_means(sdf, pdf):
    want = pdf.groupby("k")[["v", "w"]].sum().round(2)
    got = op.sum_by(sdf, "k", {"v": "v", "w": "w"}, rounding=2).toPandas().set_index("k")
    assert got.sort_index().to_numpy() == pytest.approx(want.sort_index().to_numpy())
    want = pdf.groupby("k")[["v", "w"]].mean().round(2)
    got = op.mean_by(sdf, "k", {"v": "v", "w": "w"}, rounding=2).toPandas().set_index("k")
    assert got.sort_index().to_numpy() == pytest.approx(want.sort_index().to_numpy())


def test_counts_of_known_values(sdf, pdf):
    assert as_dict(op.count_non_null_by(sdf, "k", "v"), "k", "n") == pdf.groupby("k")["v"].count().to_dict()


def test_key_figures(sdf, pdf):
    row = op.kpis(
        sdf,
        {
            "n": F.count(F.lit(1)),
            "ids": op.distinct_count(F.col("id")),
            "mean": F.avg("v"),
            "near": op.distinct_count(F.col("id"), 0.05),
        },
    ).first()
    assert row["n"] == len(pdf) and row["ids"] == pdf["id"].nunique()
    assert row["mean"] == pytest.approx(pdf["v"].mean())
    assert abs(row["near"] - row["ids"]) < 0.2 * row["ids"]


def test_mean_pivot(sdf, pdf):
    want = pdf.groupby(["k", "t"])["v"].mean().unstack()
    got = op.mean_pivot(sdf, "k", "t", "v").toPandas().set_index("k").loc[want.index, want.columns]
    assert got.to_numpy() == pytest.approx(want.to_numpy(), nan_ok=True)


def test_crosstab(sdf, pdf):
    want = pd.crosstab(pdf["k"], pdf["t"])
    got = op.crosstab_counts(sdf, "k", "t").toPandas().set_index("k").loc[want.index, want.columns]
    assert (got.to_numpy() == want.to_numpy()).all()


def test_band_crosstab(sdf, pdf):
    edges = np.arange(0, pdf["v"].max() + 25, 25)
    labels = [f"{int(a)}-{int(b)}" for a, b in zip(edges[:-1], edges[1:])]
    bands = pd.cut(pdf["v"], edges, labels=labels, right=False)
    want = pd.crosstab(bands, pdf["t"]).stack()
    got = {(r.band_label, r.t): r.n for r in op.band_crosstab(sdf, "v", "t", 25, ["x", "y"]).collect()}
    assert got == want.to_dict()


def test_segments(sdf, pdf):
    edges, labels = [0, 1, 3, 5], ["one", "three", "five"]
    want = pd.cut(pdf["w"], edges, labels=labels).value_counts().to_dict()
    got = op.dense_counts(sdf, fn.cut_ordinal(F.col("w"), edges), labels)
    assert as_dict(got, "label", "n") == want


def test_top_rows(sdf, pdf):
    want = pdf.sort_values(["v", "id"], ascending=[False, True]).head(10)["v"].tolist()
    assert [r.v for r in op.top_k(sdf, "v", 10, "id").collect()] == want


def test_correlations(sdf, pdf):
    want = pdf[["v", "w"]].corr()
    for r in op.corr_matrix(sdf, ["v", "w"]).collect():
        assert r["corr"] == pytest.approx(want.loc[r.col_a, r.col_b])


def test_correlation_with_a_constant_is_null(sdf):
    df = sdf.withColumn("one", F.lit(1.0))
    got = {(r.col_a, r.col_b): r["corr"] for r in op.corr_matrix(df, ["v", "one"]).collect()}
    assert got[("v", "one")] is None and got[("one", "one")] is None and got[("v", "v")] == 1.0


@pytest.mark.parametrize("bins", [1, 7, 30])
def test_histogram(sdf, pdf, bins):
    want, edges = np.histogram(pdf["v"].dropna(), bins=bins)
    got = op.histogram(sdf, "v", bins).orderBy("bin").toPandas()
    assert got["n"].tolist() == want.tolist()
    assert got["lo"].to_numpy() == pytest.approx(edges[:-1])
    assert got["hi"].to_numpy() == pytest.approx(edges[1:])


def test_histogram_of_whole_numbers_and_of_one_value(spark):
    values = [float(i) for i in range(31)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for bins in (3, 10, 30):
        want, _ = np.histogram(values, bins=bins)
        assert [r.n for r in op.histogram(df, "v", bins).orderBy("bin").collect()] == want.tolist()
    same = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    want, _ = np.histogram([5.0, 5.0], bins=4)
    assert [r.n for r in op.histogram(same, "v", 4).orderBy("bin").collect()] == want.tolist()


def test_density(sdf, pdf):
    x = pdf["v"].dropna().to_numpy()
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 50)
    want = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi))
    got = op.kde(sdf, "v", 50).orderBy("point").toPandas()
    assert got["x"].to_numpy() == pytest.approx(grid)
    assert got["density"].to_numpy() == pytest.approx(want, rel=1e-12)


def test_density_far_from_any_row_is_zero(spark):
    df = spark.createDataFrame([(0.0,)] * 5000 + [(1.0,)] * 5000 + [(1e6,)], "v double")
    got = [r.density for r in op.kde(df, "v", 400).orderBy("point").collect()]
    assert got[0] > 0 and got[-1] > 0 and min(got) == 0.0
    one = spark.createDataFrame([(3.0,)], "v double")
    assert [r.density for r in op.kde(one, "v", 3).collect()] == [None] * 3


@pytest.mark.parametrize("gather", [10_000, 50, 1])
@pytest.mark.parametrize("broadcast_rows", [100, 0])
def test_quantiles(sdf, pdf, gather, broadcast_rows):
    # Groups above `gather` are narrowed; with no broadcast rows intervals are joined by shuffle.
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    got = op.quantiles_by(sdf, "k", "v", probs, gather=gather, broadcast_rows=broadcast_rows).collect()
    want = pdf.dropna(subset=["k", "v"]).groupby("k")["v"]
    assert {r.k: r.n for r in got} == want.count().to_dict()
    for r in got:
        assert list(r.q) == pytest.approx(np.quantile(want.get_group(r.k), probs).tolist(), rel=1e-12)


def test_quantiles_of_a_hot_group_with_ties(spark):
    values = [("hot", float(i % 97)) for i in range(3000)] + [("cold", 1.0)] + [("flat", 2.0)] * 500
    df = spark.createDataFrame(values, "k string, v double").repartition(7)
    got = {r.k: list(r.q) for r in op.quantiles_by(df, "k", "v", gather=100).collect()}
    hot = [v for k, v in values if k == "hot"]
    assert got == {"hot": np.quantile(hot, [0.25, 0.5, 0.75]).tolist(), "cold": [1.0] * 3, "flat": [2.0] * 3}


def test_quantiles_of_crowded_and_infinite_values(spark):
    crowded = [1e-12 * i for i in range(2000)] + [1e12, -1e12, 5e-324, 0.0]
    endless = [math.inf, -math.inf, 1.0, 2.0, 1e308, -1e308, 3.0] * 3
    data = [("crowded", v) for v in crowded] + [("endless", v) for v in endless]
    df = spark.createDataFrame(data, "k string, v double").repartition(6)
    got = {r.k: list(r.q) for r in op.quantiles_by(df, "k", "v", (0.0, 0.3, 0.5, 0.9, 1.0), gather=5).collect()}
    assert got["crowded"] == pytest.approx(np.quantile(crowded, [0.0, 0.3, 0.5, 0.9, 1.0]).tolist(), rel=1e-12)
    ordered = sorted(endless)
    assert got["endless"] == [ordered[0], ordered[6], ordered[10], ordered[18], ordered[20]]


def test_box_stats(sdf, pdf):
    for r in op.box_stats(sdf, "k", "w", gather=50).collect():
        x = pdf.loc[pdf["k"] == r.k, "w"].dropna().to_numpy()
        q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert (r.n, r.q1, r["median"], r.q3) == (len(x), q1, q2, q3)
        assert r.whisker_low == min(x[x >= lo].min(), q1) and r.whisker_high == max(x[x <= hi].max(), q3)
        assert r.n_outliers == ((x < lo) | (x > hi)).sum()


def test_approximate_box_stats_are_near(sdf, pdf):
    for r in op.box_stats(sdf, "k", "v", exact=False).collect():
        x = pdf.loc[pdf["k"] == r.k, "v"].dropna()
        assert x.quantile(0.15) <= r.q1 <= x.quantile(0.35)


def test_mean_interval(sdf, pdf):
    for r in op.mean_ci_by(sdf, "k", "v").collect():
        x = pdf.loc[pdf["k"] == r.k, "v"].dropna()
        half = 1.96 * x.std(ddof=1) / math.sqrt(len(x))
        assert (r["mean"], r.ci_low, r.ci_high) == pytest.approx((x.mean(), x.mean() - half, x.mean() + half))


def test_interval_of_one_row_is_unknown(spark):
    row = op.mean_ci_by(spark.createDataFrame([("a", 4.0)], "k string, v double"), "k", "v").first()
    assert tuple(row) == ("a", 1, 4.0, None, None)


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(50, 10, 500)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, i long, v double")
    first = op.mean_ci_by(df, "k", "v", ci="bootstrap", replicates=400, row_key=["i"]).first()
    again = op.mean_ci_by(df.repartition(9), "k", "v", ci="bootstrap", replicates=400, row_key=["i"]).first()
    assert (first.ci_low, first.ci_high) == pytest.approx((again.ci_low, again.ci_high))
    half = 1.96 * x.std(ddof=1) / math.sqrt(len(x))
    assert first.ci_low == pytest.approx(x.mean() - half, abs=0.25 * half)
    assert first.ci_high == pytest.approx(x.mean() + half, abs=0.25 * half)
    with pytest.raises(ValueError, match="row_key"):
        op.mean_ci_by(df, "k", "v", ci="bootstrap")


def test_bootstrap_weights_are_poisson(spark):
    from tillgrid.operators.statistics import _poisson_weight

    draws = spark.range(200_000).withColumn("replicate", F.lit(3)).select(
        _poisson_weight(F.md5(F.concat_ws(":", "id", "replicate").cast("binary"))).alias("w")
    )
    row = draws.agg(F.avg("w"), F.var_samp("w"), F.avg((F.col("w") == 0).cast("double"))).first()
    assert tuple(row) == pytest.approx((1.0, 1.0, math.exp(-1)), abs=0.02)


def test_line_fit(sdf, pdf):
    both = pdf.dropna(subset=["v", "w"])
    slope, intercept = np.polyfit(both["w"], both["v"], 1)
    fit = op.linreg(sdf, "w", "v").first()
    assert (fit.n, fit.slope, fit.intercept) == pytest.approx((len(both), slope, intercept))
    left = both["v"] - (intercept + slope * both["w"])
    s = math.sqrt((left**2).sum() / (len(both) - 2))
    assert fit.residual_sd == pytest.approx(s)
    sxx = ((both["w"] - both["w"].mean()) ** 2).sum()
    for r in op.linreg_band(sdf, "w", "v", grid=11).collect():
        assert r.x == pytest.approx(both["w"].min() + r.point * (both["w"].max() - both["w"].min()) / 10)
        half = 1.96 * s * math.sqrt(1 / len(both) + (r.x - both["w"].mean()) ** 2 / sxx)
        assert (r.band_low, r.band_high) == pytest.approx(
            (intercept + slope * r.x - half, intercept + slope * r.x + half)
        )


def test_melt(spark, pdf):
    wide = pd.crosstab(pdf["k"], pdf["t"]).reset_index()
    want = wide.melt(id_vars="k", var_name="t", value_name="n")
    got = op.melt(spark.createDataFrame(wide), "k", "t", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.itertuples(index=False)))


def test_melt_keeps_nulls_and_mixes_types(spark, rows):
    df = spark.createDataFrame([("r", 1, "x"), ("s", None, None)], "id string, a int, b string")
    assert rows(op.melt(df, "id", "k", "v")) == [("r", "a", "1"), ("r", "b", "x"), ("s", "a", None), ("s", "b", None)]


def test_period_change(spark, pdf):
    yearly = pdf.dropna(subset=["w"]).groupby("w")["v"].mean()
    df = spark.createDataFrame([(k, v) for k, v in yearly.items()], "w double, v double")
    got = op.pct_change(df, "w", "v").orderBy("w").toPandas()["pct_change"]
    assert got.to_numpy(dtype=float) == pytest.approx((yearly.pct_change() * 100).to_numpy(), nan_ok=True)


def test_share_of_total(sdf, pdf):
    got = sorted(r.percentage for r in op.share_of_total(sdf.where("v is not null"), "v").collect())
    assert got == pytest.approx(sorted(pdf["v"].dropna() / pdf["v"].sum() * 100))


def test_points_and_grids(sdf, pdf):
    both = pdf.dropna(subset=["v", "w"])
    assert op.scatter_points(sdf, "v", "w", "k").count() == len(both)
    want = both.groupby([np.floor(both["v"] / 20), np.floor(both["w"] / 2)]).size().to_dict()
    got = {(r.x_cell, r.y_cell): r.n for r in op.scatter_grid(sdf, "v", "w", 20, 2).collect()}
    assert got == want
    assert {(r.x_cell, r.y_cell): r.n for r in op.group_points(sdf, "v", "w", 2).collect()} == both.groupby(
        [np.floor(both["v"] / 2), np.floor(both["w"] / 2)]
    ).size().to_dict()
    held = pdf.dropna(subset=["t", "w"])
    want = held.groupby(["t", np.floor(held["w"] / 2)]).size().to_dict()
    assert {(r.t, r.y_cell): r.n for r in op.category_grid(sdf, "t", "w", 2).collect()} == want
