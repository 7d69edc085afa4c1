"""Operators for large training-data corpora (self-contained; nothing else imports it)."""
