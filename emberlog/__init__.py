"""emberlog: log-telemetry SQL on Spark DataFrames."""

__version__ = "0.1.0"
