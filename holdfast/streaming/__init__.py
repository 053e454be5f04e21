"""Structured Streaming forms of the quote, trade and run-record operators."""
