"""Account portfolio."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillgrid import operators as op
from tillgrid.functions import year_of
from tillgrid.plans.panels import Panels
from tillgrid.plans.shared import scope, then

ALERTS = ("mobile_banking", "sms_alerts", "email_alerts")


def prepare_accounts(accounts: DataFrame) -> DataFrame:
    return accounts.withColumn("year_opened", year_of(F.col("opening_date")))


def chosen_accounts(
    accounts: DataFrame, years: Sequence[int] | None = None, types: Sequence[str | None] | None = None
) -> DataFrame:
    """The filter of the page. Left open, it takes every known year and every type, null included."""
    if years is None:
        accounts = op.drop_null(accounts, "year_opened")
    else:
        accounts = op.filter_in(accounts, {"year_opened": years})
        if "opening_date" in accounts.columns:
            # Says the same of the date itself, which the scan can use.
            accounts = op.filter_years(accounts, "opening_date", years)
    return accounts if types is None else op.filter_in(accounts, {"account_type": types})


def accounts_report(
    accounts: DataFrame,
    years: Sequence[int] | None = None,
    types: Sequence[str | None] | None = None,
    alert_values: Sequence[str] | None = None,
    balance_cell: float = 10_000,
    interest_cell: float = 10_000,
    top: int = 10,
    shared: bool = False,
) -> Panels:
    """Panels of a ``prepare_accounts`` frame; which take the filter and which do not is fixed.

    With ``shared`` the grouped panels come from one scan of all accounts and one of the chosen ones.
    """
    every = scope(accounts, shared)
    chosen = scope(chosen_accounts(accounts, years, types), shared)
    flows = {"deposits": "total_deposits", "withdrawals": "total_withdrawals"}

    interest = {"interest": "interest_earned"}
    yearly = chosen.ask(op.mean_by, "year_opened", {"mean_balance": "current_balance"})
    net_flow = every.ask(op.sum_by, "product_code", {"net_flow": "net_flow"})
    activity = chosen.ask(op.mean_by, "account_type", {"mean_activity": "activity_score"})

    return Panels(
        {
            "year_options": every.ask(op.domain, "year_opened"),
            "type_options": every.ask(op.domain, "account_type", sort=False, drop_null=False),
            "active_share": chosen.ask(op.value_shares, "active_account"),
            "by_type": chosen.ask(op.value_counts, "account_type"),
            "by_year": chosen.ask(op.value_counts, "year_opened", order="key"),
            "alerts": chosen.ask(op.flag_matrix, ALERTS, alert_values),
            "branch_flows": then(every.ask(op.sum_by, "branch", flows), op.order_by_key, "branch"),
            "product_flows": then(every.ask(op.sum_by, "product_code", flows), op.order_by_key, "product_code"),
            "age_by_status": chosen.ask(op.value_counts, ["account_age_years", "status"], order="key"),
            "product_net_flow": then(net_flow, op.order_desc, "net_flow", "product_code"),
            "product_interest": then(
                every.ask(op.sum_by, "product_code", interest), op.order_desc, "interest", "product_code"
            ),
            # As many groups as customers: not for the shared scan.
            "top_customers": lambda: op.top_k(op.sum_by(accounts, "customer_id", interest), "interest", top, "customer_id"),
            "activity_by_type": then(activity, op.order_asc, "mean_activity", "account_type"),
            "balance_histogram": chosen.ask(op.histogram, "current_balance", 30),
            "balance_density": chosen.ask(op.kde, "current_balance", 200),
            # Bars and curve as one chart, from one first scan.
            "balance_chart": chosen.ask(op.histogram_with_density, "current_balance", 30, 200),
            "balance_by_year": then(yearly, op.order_by_key, "year_opened"),
            "balance_growth": then(yearly, op.pct_change, "year_opened", "mean_balance", "growth_pct"),
            "balance_interest_points": every.ask(op.scatter_points, "current_balance", "interest_earned"),
            "balance_interest_grid": every.ask(
                op.scatter_grid, "current_balance", "interest_earned", balance_cell, interest_cell
            ),
        }
    )
