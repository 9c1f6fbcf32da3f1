"""Queries of the library over the common test tables, each with DuckDB SQL where SQL can express it."""
