"""Readers (runs, request bodies, derived fixture views) and sinks (outbox)."""
