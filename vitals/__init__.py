"""Batch and streaming operators over personal health exports, on Spark."""
