"""Training-data pipeline operators (license scan, dedup, tokenising, PII, decontamination, ...).

Nothing else in the library imports this subpackage.
"""
