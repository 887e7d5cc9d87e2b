"""Structured Streaming forms of the operators that have a live one."""
