"""Fixtures derived from the driver's tables, the registered queries, and
the DuckDB SQL each of them is checked against."""
