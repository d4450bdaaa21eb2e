"""Operators of a training-data pipeline (optional part; nothing else imports it)."""
