"""Structured Streaming versions of the monitoring, anomaly and scoring operators."""
