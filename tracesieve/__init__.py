"""Turn tables of model interaction logs into a curated evaluation dataset, on Spark."""

__version__ = "0.1.0"
