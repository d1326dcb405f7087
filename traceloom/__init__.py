"""Spark-first analytics over requirement sets, work products and their links."""

__all__ = ["session", "operators", "sources", "functions", "plans", "streaming"]
