"""Declared datasets: source header, column name, type and how bad text is treated."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

MONEY = "decimal(18,2)"


@dataclass(frozen=True)
class Field:
    """``mode`` is ``strict`` (bad text fails the query) or ``lenient`` (bad text is NULL)."""

    header: str
    name: str
    dtype: str = "string"
    mode: str = "strict"
    optional: bool = False


@dataclass(frozen=True)
class Dataset:
    """``rest`` takes the columns that are not declared as well, as they are."""

    name: str
    fields: tuple[Field, ...]
    rest: bool = False

    def with_money(self, dtype: str) -> Dataset:
        """The same dataset with amounts of another type, where two decimals are not enough."""
        return replace(
            self, fields=tuple(replace(f, dtype=dtype) if f.dtype == MONEY else f for f in self.fields)
        )

    def schema(self) -> T.StructType:
        """Schema of the conformed frame with every column present."""
        schema = T.StructType()
        for f in self.fields:
            schema = schema.add(f.name, T.StructType.fromDDL(f"c {f.dtype}")["c"].dataType)
        return schema


ACCOUNTS = Dataset(
    "accounts",
    (
        Field("Customer ID", "customer_id"),
        Field("Account Type", "account_type"),
        Field("Opening Date", "opening_date", "timestamp_ntz", "lenient"),
        Field("Active Account", "active_account"),
        Field("Status", "status"),
        Field("Account Age (Years)", "account_age_years", "double"),
        Field("Mobile Banking", "mobile_banking"),
        Field("SMS Alerts", "sms_alerts"),
        Field("Email Alerts", "email_alerts"),
        Field("Branch", "branch"),
        Field("Product Code", "product_code"),
        Field("Total Deposits", "total_deposits", MONEY),
        Field("Total Withdrawals", "total_withdrawals", MONEY),
        Field("Net Flow", "net_flow", MONEY),
        Field("Interest Earned", "interest_earned", MONEY),
        Field("Current Balance", "current_balance", MONEY),
        Field("Activity Score", "activity_score", "double"),
    ),
)

CUSTOMERS = Dataset(
    "customers",
    (
        Field("Customer ID", "customer_id"),
        Field("Customer Since", "customer_since", "timestamp_ntz", "lenient"),
        Field("Tenure", "tenure_months", "double"),
        Field("Employment Sector", "employment_sector"),
        Field("Region", "region"),
        Field("Gender", "gender"),
        Field("Income", "income", "double", optional=True),
        Field("Age Binned", "age_binned", optional=True),
    ),
)

EMPLOYEES = Dataset(
    "employees",
    (
        Field("Employee ID", "employee_id"),
        Field("JoiningDate", "joining_date", "timestamp_ntz"),
        Field("Branch", "branch"),
        Field("Department", "department"),
        Field("Position", "position"),
        Field("Gender", "gender"),
        Field("Age", "age", "double"),
        Field("IncomeLevelNumeric", "income_level", "double"),
        Field("EducationLevel", "education_level"),
        Field("AttritionRisk", "attrition_risk", optional=True),
    ),
)

BRANCHES = Dataset(
    "branches",
    (
        Field("Branch Name", "branch_name"),
        Field("Region", "region"),
        Field("Profitability Index", "profitability_index", "double"),
        Field("Loan Portfolio (GHS Million)", "loan_portfolio_ghs_million", "double"),
        Field("Deposits (GHS Million)", "deposits_ghs_million", "double"),
        Field("Loan Portfolio Quality (%)", "loan_portfolio_quality_pct", "double"),
        Field("Collection Rate (%)", "collection_rate_pct", "double"),
        Field("NPL Rate (%)", "npl_rate_pct", "double"),
        Field("Market Share (%)", "market_share_pct", "double"),
        Field("Performance Category", "performance_category"),
        Field("Active Customers", "active_customers", "double"),
        Field("Staff Count", "staff_count", "double"),
        Field("Customer Service Desks", "customer_service_desks", "double"),
        Field("Customer Satisfaction (5.0)", "customer_satisfaction", "double"),
        Field("GPS Latitude", "gps_latitude", "double"),
        Field("GPS Longitude", "gps_longitude", "double"),
        Field("ATM Available", "atm_available"),
        Field("Disability Access", "disability_access"),
    ),
)

AGENTS = Dataset(
    "agents",
    (
        Field("agent_id", "agent_id"),
        Field("region", "region"),
        Field("performance_tier_clean", "performance_tier"),
        Field("monthly_transactions", "monthly_transactions", "double"),
        Field("monthly_volume_(ghs)", "monthly_volume_ghs", MONEY),
        Field("monthly_commission_(ghs)", "monthly_commission_ghs", MONEY),
        Field("commission_rate_(%)", "commission_rate_pct", "double"),
        Field("active_customer_base", "active_customer_base", "double"),
        Field("working_hours", "working_hours"),
        Field("training_completed", "training_completed"),
        Field("months_active", "months_active", "double"),
        Field("services_offered", "services_offered"),
        Field("gps_latitude", "gps_latitude", "double"),
        Field("gps_longitude", "gps_longitude", "double"),
        Field("compliance_score", "compliance_score", "double", optional=True),
    ),
)

INDUSTRY_AGES = Dataset(
    "industry_data",
    (Field("Age Groups", "age_group"), Field("Total", "total", "double")),
)

INDUSTRY_POPULATION = Dataset(
    "industry_pop",
    (Field("Industry", "industry"), Field("Total population", "total_population", "double")),
)

REGION_POPULATION = Dataset("region_pop", (Field("Region", "region", optional=True),), rest=True)

INDUSTRY_BY_REGION = Dataset("regbyindustry", (Field("Region", "region"),), rest=True)
