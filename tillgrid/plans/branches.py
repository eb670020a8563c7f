"""Branch performance, footfall and coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillgrid import operators as op
from tillgrid.functions import coverage_pct, describe_row, flag_value, ratio
from tillgrid.plans.panels import Panels
from tillgrid.plans.shared import scope
from tillgrid.sources import inline_table

# The district each branch serves.
BRANCH_DISTRICTS = {
    "Accra Central": "Accra Metropolitan Area (AMA)",
    "Adenta": "Adentan Municipal",
    "Madina": "La Nkwantanang Madina Municipal",
    "Tema": "Tema Metropolitan Area (TMA)",
    "Kumasi Central": "Kumasi Metropolitan Area (KMA)",
    "Adum": "KMA-Bantama",
    "Bantama": "KMA-Bantama",
    "Cape Coast": "Cape Cape Metropolitan Area (CCMA)",
    "Koforidua": "Juaben Municipal",
    "Takoradi": "Sekondi Takoradi Metropolitan Area (STMA)",
    "Tamale": "TMA-Tamale Central",
    "Ho": "Ho Municipal",
    "Wa": "Wa Municipal",
    "Bolgatanga": "Bolgatanga Municipal",
    "Dambai": "Krachi East Municipal",
    "Damongo": "West Gonja",
    "Sunyani": "Sunyani Municipal",
    "Sefwi Wiawso": "Sefwi Wiawso Municipal",
    "Techiman": "Techiman Municipal",
    "Head Office": "Accra Metropolitan Area (AMA)",
}

# District populations.
DISTRICT_POPULATION = (
    ("Sekondi Takoradi Metropolitan Area (STMA)", 85174),
    ("Cape Cape Metropolitan Area (CCMA)", 67570),
    ("Accra Metropolitan Area (AMA)", 121103),
    ("Adentan Municipal", 108423),
    ("La Nkwantanang Madina Municipal", 83831),
    ("Tema Metropolitan Area (TMA)", 69392),
    ("Ho Municipal", 61676),
    ("Juaben Municipal", 21253),
    ("Kumasi Metropolitan Area (KMA)", 164504),
    ("KMA-Bantama", 43026),
    ("Sefwi Wiawso Municipal", 51890),
    ("Sunyani Municipal", 64799),
    ("Techiman Municipal", 89186),
    ("Krachi East Municipal", 38222),
    ("TMA-Tamale Central", 38878),
    ("West Gonja", 10305),
    ("Bolgatanga Municipal", 41187),
    ("Wa Municipal", 55802),
)

METRICS = (
    "loan_portfolio_ghs_million",
    "deposits_ghs_million",
    "profitability_index",
    "loan_portfolio_quality_pct",
    "collection_rate_pct",
    "npl_rate_pct",
    "market_share_pct",
)


def district_coverage(
    branches: DataFrame,
    mapping: Mapping[str, str] = BRANCH_DISTRICTS,
    population: Sequence[tuple[str, int]] = DISTRICT_POPULATION,
) -> DataFrame:
    """Active customers of each branch as a percentage of its district's population."""
    names = [name for name, _ in population]
    if len(set(names)) < len(names):
        raise ValueError("a district is listed twice; its branches would be counted twice")
    districts = inline_table(branches.sparkSession, population, "district string, population bigint")
    placed = branches.select(
        "branch_name", "active_customers", op.map_lookup(F.col("branch_name"), mapping).alias("matched_district")
    )
    joined = op.join_dim(placed, districts, "matched_district", "district", bounded=True)
    coverage = coverage_pct(F.col("active_customers"), F.col("population")).alias("coverage_pct")
    table = joined.select("branch_name", "matched_district", "active_customers", "population", coverage)
    return op.order_desc(table, "coverage_pct", ["branch_name", "active_customers"])


def branches_report(
    branches: DataFrame,
    mapping: Mapping[str, str] = BRANCH_DISTRICTS,
    population: Sequence[tuple[str, int]] = DISTRICT_POPULATION,
    load_cell: float = 100,
    satisfaction_cell: float = 0.5,
    exact_quartiles: bool = True,
    shared: bool = False,
) -> Panels:
    """With ``shared`` the grouped panels come from one scan."""
    every = scope(branches, shared)
    loads = branches.withColumns(
        {
            "customer_to_staff": ratio(F.col("active_customers"), F.col("staff_count")),
            "service_capacity_score": ratio(F.col("customer_service_desks"), F.col("active_customers")),
        }
    )
    popup = describe_row(
        [
            F.col("branch_name"),
            " (",
            F.col("region"),
            ")<br>Perf: ",
            F.col("performance_category"),
            "<br>Profit Index: ",
            F.col("profitability_index"),
        ]
    )
    best = branches.select(
        "branch_name", "region", "profitability_index", "loan_portfolio_ghs_million", "deposits_ghs_million"
    )
    return Panels(
        {
            "top_profitability": lambda: op.top_k(best, "profitability_index", 5, ["branch_name", "region"]),
            "categories": every.ask(op.value_counts, "performance_category"),
            "correlations": lambda: op.corr_matrix(branches, METRICS),
            "customer_to_staff": lambda: loads.select("branch_name", "customer_to_staff"),
            "capacity": lambda: op.order_desc(
                loads.select("branch_name", "customer_to_staff", "service_capacity_score"),
                "customer_to_staff",
                "branch_name",
            ),
            "load_satisfaction_points": lambda: op.scatter_points(
                loads, "customer_to_staff", "customer_satisfaction", "performance_category"
            ),
            "load_satisfaction_grid": lambda: op.scatter_grid(
                loads,
                "customer_to_staff",
                "customer_satisfaction",
                load_cell,
                satisfaction_cell,
                "performance_category",
            ),
            "regions": every.ask(op.value_counts, "region"),
            "map_centre": every.ask(op.kpis, {"lat": F.avg("gps_latitude"), "lon": F.avg("gps_longitude")}),
            "map_points": lambda: op.map_points(
                branches,
                "gps_latitude",
                "gps_longitude",
                {"popup": popup, "color": flag_value(F.col("atm_available"))},
            ),
            "accessibility": every.ask(op.value_counts, "disability_access"),
            "access_customers": lambda: op.box_stats(branches, "disability_access", "active_customers", exact_quartiles),
            "access_outliers": lambda: op.box_outliers(branches, "disability_access", "active_customers", exact_quartiles),
            "coverage": lambda: district_coverage(branches, mapping, population),
        }
    )
