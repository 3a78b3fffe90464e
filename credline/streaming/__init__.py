"""Structured Streaming forms: stage hops over new files, stateful decision folds."""
