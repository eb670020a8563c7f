"""Workforce."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillgrid import operators as op
from tillgrid.functions import tenure_years_as_of, year_of
from tillgrid.plans.panels import Panels
from tillgrid.plans.shared import scope, then


def prepare_employees(employees: DataFrame, as_of: dt.date) -> DataFrame:
    """Joining year and tenure on the day ``as_of``, which a rerun must repeat."""
    employees = op.ensure_column(employees, "attrition_risk", None)
    return employees.withColumns(
        {
            "joining_year": year_of(F.col("joining_date")),
            "tenure_years": tenure_years_as_of(F.col("joining_date"), as_of),
        }
    )


def employees_report(
    employees: DataFrame,
    branch: str = "All",
    department: str = "All",
    joining_year: int | str = "All",
    education_levels: Sequence[str] = (),
    band_width: float = 10_000,
    shared: bool = False,
) -> Panels:
    """Panels of a ``prepare_employees`` frame; options and education by income leave the filter out.

    With ``shared`` the grouped panels come from one scan of all employees and one of the chosen ones.
    """
    filters = {"branch": branch, "department": department, "joining_year": joining_year}
    every = scope(employees, shared)
    chosen = scope(op.filter_eq_optional(employees, filters), shared)
    hired = chosen.ask(op.count_non_null_by, "joining_year", "employee_id")
    tenure = chosen.ask(op.mean_by, "department", {"mean_tenure": "tenure_years"})
    ages = chosen.ask(op.mean_by, "position", {"mean_age": "age"})
    panels = {
        "branch_options": every.ask(op.options_with_all, "branch"),
        "department_options": every.ask(op.options_with_all, "department"),
        "year_options": every.ask(op.options_with_all, "joining_year"),
        "kpis": chosen.ask(
            op.kpis,
            {
                "n_employees": op.distinct_count(F.col("employee_id")),
                "mean_tenure": F.avg("tenure_years"),
                "mean_age": F.avg("age"),
            },
        ),
        "hiring": then(hired, op.order_by_key, "joining_year"),
        "departments": chosen.ask(op.value_shares, "department"),
        "tenure_by_department": then(tenure, op.order_by_key, "department"),
        "age_by_position": then(ages, op.order_by_key, "position"),
        "gender": chosen.ask(op.value_shares, "gender"),
    }
    if education_levels:
        panels["education_by_income"] = lambda: op.band_crosstab(
            employees, "income_level", "education_level", band_width, education_levels
        )
    return Panels(panels)
