"""Ledgers and incremental jobs."""
