"""Operators for building training corpora (optional; nothing else imports them)."""
