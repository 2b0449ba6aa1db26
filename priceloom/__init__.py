"""Spark-first analytics for multi-supplier price lists."""
