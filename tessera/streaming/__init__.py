"""Structured Streaming operators: replay, deduplication, telemetry, rate limits, request frontier."""
