"""Structured Streaming forms of the receipt and window operators."""
