"""The operators and reports bound to the driver tables, each with its SQL."""
