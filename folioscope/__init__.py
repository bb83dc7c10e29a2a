"""Forensic ledger analytics on Spark DataFrames."""

from folioscope.settings import Settings

__all__ = ["Settings"]
