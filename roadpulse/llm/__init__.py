"""Operators for preparing training text: filters, deduplication, decontamination, redaction, mixing, archives."""
