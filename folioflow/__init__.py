"""Spark-first analytics over structured documents and activity logs."""
