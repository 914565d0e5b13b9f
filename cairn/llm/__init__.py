"""Operators for the preparation of language-model training data; nothing else imports this package."""
