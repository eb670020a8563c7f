"""Agent performance, coverage and customer interaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillgrid import operators as op
from tillgrid.functions import describe_row, engagement_score, round_even
from tillgrid.plans.panels import Panels
from tillgrid.plans.shared import scope, then


def agents_report(
    agents: DataFrame,
    training_values: Sequence[str] | None = None,
    score_places: int | None = None,
    rate_cell: float = 0.5,
    volume_cell: float = 1000,
    base_cell: float = 10,
    score_cell: float = 1,
    map_cell: float = 0.5,
    exact_quartiles: bool = True,
    shared: bool = False,
) -> Panels:
    """``score_places`` rounds the engagement score before agents are grouped by it.

    With ``shared`` the grouped panels come from one scan.
    """
    every = scope(agents, shared)
    score = engagement_score(
        F.col("monthly_transactions"), F.col("active_customer_base"), F.col("months_active")
    )
    scored = agents.withColumn("engagement_score", score)
    figures = ("monthly_transactions", "monthly_volume_ghs", "monthly_commission_ghs")

    def by_score() -> DataFrame:
        rows = scored
        if score_places is not None:
            rows = rows.withColumn("engagement_score", round_even(F.col("engagement_score"), score_places))
        sums = {"total_monthly_volume_ghs": "monthly_volume_ghs"}
        return op.sum_by(rows, ["engagement_score", "performance_tier"], sums)

    popup = describe_row(
        [
            "<b>ID:</b> ",
            F.col("agent_id"),
            "<br><b>Region:</b> ",
            F.col("region"),
            "<br><b>Tier:</b> ",
            F.col("performance_tier"),
            "<br><b>Service:</b> ",
            F.col("services_offered"),
        ]
    )
    best = agents.select(
        "agent_id", "region", "monthly_volume_ghs", "monthly_commission_ghs", "performance_tier"
    )
    panels = {
        "top_volume": lambda: op.top_k(best, "monthly_volume_ghs", 10, "agent_id"),
        "tier_means": then(
            every.ask(op.mean_by, "performance_tier", {c: c for c in figures}, rounding=2), op.order_by_key, "performance_tier"
        ),
        "rate_volume_points": lambda: op.scatter_points(
            agents, "commission_rate_pct", "monthly_volume_ghs", "performance_tier"
        ),
        "rate_volume_grid": lambda: op.scatter_grid(
            agents, "commission_rate_pct", "monthly_volume_ghs", rate_cell, volume_cell, "performance_tier"
        ),
        "regions": every.ask(op.value_counts, "region"),
        "region_totals": then(
            every.ask(op.sum_by, "region", {c: c for c in figures}, rounding=2), op.order_desc, "monthly_transactions", "region"
        ),
        # The chart is titled an average but draws the total above; this is the average.
        "region_mean_transactions": then(
            every.ask(op.mean_by, "region", {"mean_monthly_transactions": "monthly_transactions"}, rounding=2),
            op.order_desc,
            "mean_monthly_transactions",
            "region",
        ),
        "map_centre": every.ask(op.kpis, {"lat": F.avg("gps_latitude"), "lon": F.avg("gps_longitude")}),
        "map_points": lambda: op.map_points(agents, "gps_latitude", "gps_longitude", {"popup": popup}),
        "map_clusters": lambda: op.group_points(agents, "gps_latitude", "gps_longitude", map_cell),
        "base_by_tier": every.ask(op.mean_ci_by, "performance_tier", "active_customer_base"),
        "hours_base_points": lambda: op.scatter_points(
            agents, "working_hours", "active_customer_base", "performance_tier"
        ),
        # Working hours are text, so each text is a column of cells of its own.
        "hours_base_grid": lambda: op.category_grid(
            agents, "working_hours", "active_customer_base", base_cell, "performance_tier"
        ),
        "base_by_training": then(
            every.ask(op.mean_by, "training_completed", {"mean_customer_base": "active_customer_base"}, rounding=2),
            op.order_by_key,
            "training_completed",
        ),
        "region_training": then(
            every.ask(op.mean_pivot, "region", "training_completed", "monthly_volume_ghs", training_values), op.order_by_key, "region"
        ),
        "top_engagement": lambda: op.top_k(
            scored.select("agent_id", "engagement_score"), "engagement_score", 10, "agent_id"
        ),
        "engagement_volume_points": lambda: op.scatter_points(
            scored, "engagement_score", "monthly_volume_ghs", "performance_tier"
        ),
        "engagement_volume_grid": lambda: op.scatter_grid(
            scored, "engagement_score", "monthly_volume_ghs", score_cell, volume_cell, "performance_tier"
        ),
        "engagement_summary": lambda: op.top_k(
            by_score(), "total_monthly_volume_ghs", 10, ["engagement_score", "performance_tier"]
        ),
    }
    if "compliance_score" in agents.columns:
        panels["compliance_by_tier"] = lambda: op.box_stats(
            agents, "performance_tier", "compliance_score", exact_quartiles
        )
        panels["compliance_outliers"] = lambda: op.box_outliers(
            agents, "performance_tier", "compliance_score", exact_quartiles
        )
    return Panels(panels)
