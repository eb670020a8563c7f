"""The same computations in plain pandas and in Spark on one lineitem-like Parquet file or folder.

    python bench_pandas.py PATH [RUNS]

Each figure is the median over RUNS after one warm-up and includes reading the columns it needs.
"""

from __future__ import annotations

import json
import statistics
import sys
import time

import numpy as np
import pandas as pd

from tillgrid import operators as op
from tillgrid.session import local_session


def in_pandas(path: str) -> dict:
    def read(*cols):
        return pd.read_parquet(path, columns=list(cols))

    def box():
        groups = read("l_returnflag", "l_extendedprice").groupby("l_returnflag")["l_extendedprice"]
        return groups.quantile([0.25, 0.5, 0.75])

    def density():
        x = read("l_discount")["l_discount"].to_numpy()
        h = x.std(ddof=1) * len(x) ** -0.2
        return [np.exp(-0.5 * ((g - x) / h) ** 2).sum() for g in np.linspace(x.min(), x.max(), 200)]

    sums = ["l_suppkey", "l_extendedprice", "l_quantity"]
    metrics = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return {
        "value_counts": lambda: read("l_returnflag")["l_returnflag"].value_counts(),
        "count_by_two": lambda: read("l_returnflag", "l_linestatus").groupby(["l_returnflag", "l_linestatus"]).size(),
        "sum_by": lambda: read(*sums).groupby("l_suppkey").sum(),
        "mean_by": lambda: read(*sums).groupby("l_suppkey").mean(),
        "top_k": lambda: read("l_suppkey", "l_extendedprice").groupby("l_suppkey").sum().nlargest(10, "l_extendedprice"),
        "corr_matrix": lambda: read(*metrics).corr(),
        "histogram": lambda: np.histogram(read("l_extendedprice")["l_extendedprice"], bins=30),
        "quartiles": box,
        "kde": density,
    }


def in_spark(spark, path: str) -> dict:
    df = spark.read.parquet(path)
    sums = {"price": "l_extendedprice", "quantity": "l_quantity"}
    frames = {
        "value_counts": lambda: op.value_counts(df, "l_returnflag"),
        "count_by_two": lambda: op.value_counts(df, ["l_returnflag", "l_linestatus"]),
        "sum_by": lambda: op.sum_by(df, "l_suppkey", sums),
        "mean_by": lambda: op.mean_by(df, "l_suppkey", sums),
        "top_k": lambda: op.top_k(op.sum_by(df, "l_suppkey", {"s": "l_extendedprice"}), "s", 10, "l_suppkey"),
        "corr_matrix": lambda: op.corr_matrix(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
        "histogram": lambda: op.histogram(df, "l_extendedprice", 30),
        "quartiles": lambda: op.quantiles_by(df, "l_returnflag", "l_extendedprice"),
        "kde": lambda: op.kde(df, "l_discount"),
    }
    return {k: (lambda f=f: f().write.format("noop").mode("overwrite").save()) for k, f in frames.items()}


def median(fn, runs: int) -> float:
    times = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        fn()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times[1:]), 3)


def main() -> None:
    path, runs = sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 3
    spark = local_session(8, "bench-pandas")
    ours, theirs = in_spark(spark, path), in_pandas(path)
    for name in ours:
        print(json.dumps({"query": name, "spark": median(ours[name], runs), "pandas": median(theirs[name], runs)}), flush=True)


if __name__ == "__main__":
    main()
