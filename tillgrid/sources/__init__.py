"""Reading, typing, staging and exporting tables."""

from tillgrid.sources.inline import inline_table
from tillgrid.sources.readers import (
    conform,
    normalize_headers,
    normalize_nulls,
    read_bundle,
    read_table,
    read_texts,
)
from tillgrid.sources.schemas import (
    ACCOUNTS,
    AGENTS,
    BRANCHES,
    CUSTOMERS,
    EMPLOYEES,
    INDUSTRY_AGES,
    INDUSTRY_BY_REGION,
    INDUSTRY_POPULATION,
    REGION_POPULATION,
    Dataset,
    Field,
)
from tillgrid.sources.incremental import changed_files, list_files, stage_changes
from tillgrid.sources.quarantine import Quarantine, read_quarantined
from tillgrid.sources.writers import export_csv, stage

__all__ = [
    "ACCOUNTS",
    "AGENTS",
    "BRANCHES",
    "CUSTOMERS",
    "EMPLOYEES",
    "INDUSTRY_AGES",
    "INDUSTRY_BY_REGION",
    "INDUSTRY_POPULATION",
    "REGION_POPULATION",
    "Dataset",
    "Field",
    "Quarantine",
    "changed_files",
    "conform",
    "export_csv",
    "inline_table",
    "list_files",
    "normalize_headers",
    "normalize_nulls",
    "read_bundle",
    "read_quarantined",
    "read_table",
    "read_texts",
    "stage",
    "stage_changes",
]
