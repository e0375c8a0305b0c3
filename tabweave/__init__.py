"""Cross-tab alignment and reporting on Spark DataFrames."""

__all__ = ["functions", "sources", "operators", "plans", "streaming"]
