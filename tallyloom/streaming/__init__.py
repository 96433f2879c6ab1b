"""Structured Streaming intake of the reconciliation library."""
