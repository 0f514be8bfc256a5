"""auditloom: a Spark-native engine for membership audits and corpus preparation."""

__version__ = "0.1.0"
