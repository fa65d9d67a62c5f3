"""Structured Streaming counterparts of the session, ledger and event operators."""
