"""equilens: group-parity auditing and mitigation on Spark (DataFrame, SQL,
Spark ML and Structured Streaming). See README.md for the operator map."""

__version__ = "0.1.0"
