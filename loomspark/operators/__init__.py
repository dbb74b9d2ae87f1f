"""Feature operators: each adds columns to a table and keeps its rows."""
