"""Quillstream: ledger extraction, reconciliation and data preparation on PySpark."""
