"""Spark-native analytics for a multi-tenant document-intelligence workload."""
