"""Column expressions: nulls, parsing, numbers, binning, text."""

from tillgrid.functions.binning import (
    band_high,
    band_label,
    band_low,
    cut_label,
    cut_ordinal,
    cut_width,
)
from tillgrid.functions.nulls import NA_TOKENS, is_in, nan_to_null, null_tokens
from tillgrid.functions.numbers import (
    coverage_pct,
    engagement_score,
    money_sum,
    ratio,
    round_even,
    tenure_years_as_of,
    tenure_years_from_months,
)
from tillgrid.functions.parsing import parse_ts, regex_rewrite, sheet_csv_url, to_number, year_of
from tillgrid.functions.text import describe_row, flag_below, flag_first_segment, flag_value

__all__ = [
    "NA_TOKENS",
    "band_high",
    "band_label",
    "band_low",
    "coverage_pct",
    "cut_label",
    "cut_ordinal",
    "cut_width",
    "describe_row",
    "engagement_score",
    "flag_below",
    "flag_first_segment",
    "flag_value",
    "is_in",
    "money_sum",
    "nan_to_null",
    "null_tokens",
    "parse_ts",
    "ratio",
    "regex_rewrite",
    "round_even",
    "sheet_csv_url",
    "tenure_years_as_of",
    "tenure_years_from_months",
    "to_number",
    "year_of",
]
