"""Time-series quality control, interval logic and evaluation as Spark DataFrame operators."""
