"""Whole queries: adapters that turn the driver's tables into canonical relations, and the registered plans."""
