"""Operators on log frames: rows, aggregations, alerts, dashboard and the entry store."""
