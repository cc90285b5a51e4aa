"""plumbline: a Spark-first engine for software-metrics baselines and corpus preparation."""

__version__ = "0.1.0"
