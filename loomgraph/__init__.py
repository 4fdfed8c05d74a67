"""Spark-first analytics over weighted property graphs and the tables behind them."""

__all__ = ["__version__"]
__version__ = "0.1.0"
