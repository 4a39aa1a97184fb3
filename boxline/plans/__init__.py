"""Compositions of operators: ingestion, fixture outputs, report pages, query list."""
