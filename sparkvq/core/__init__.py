"""Numerics on the driver and in Arrow batches; nothing here needs Spark."""
