"""Ledger tables at rest, raw block files and their writers."""
