"""Structured Streaming versions of the deadline scans, the lifecycle fold and
the counters. Each has a batch twin in ``duewatch.operators`` that it is tested
against."""
