"""Spark-first engine for noisy author fields: splitting, features, rules, models and their analytics."""

__version__ = "0.1.0"
