"""Structured Streaming operators over live telemetry."""
