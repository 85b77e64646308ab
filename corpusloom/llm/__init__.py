"""Operators for preparing large-language-model training data (optional; nothing else imports this)."""
