"""Operators that prepare training data: de-duplication, redaction, leakage, mixing, subjects."""
