"""Reports: typed frames and choices in, one DataFrame per panel out. Nothing runs until an action."""

from tillgrid.plans.accounts import accounts_report, prepare_accounts
from tillgrid.plans.agents import agents_report
from tillgrid.plans.branches import BRANCH_DISTRICTS, DISTRICT_POPULATION, branches_report
from tillgrid.plans.customers import customer_insights, customers_report, prepare_customers
from tillgrid.plans.employees import employees_report, prepare_employees
from tillgrid.plans.market import export_ages, market_insights, market_report

__all__ = [
    "BRANCH_DISTRICTS",
    "DISTRICT_POPULATION",
    "accounts_report",
    "agents_report",
    "branches_report",
    "customer_insights",
    "customers_report",
    "employees_report",
    "export_ages",
    "market_insights",
    "market_report",
    "prepare_accounts",
    "prepare_customers",
    "prepare_employees",
]
