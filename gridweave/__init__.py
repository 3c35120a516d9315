"""Gridweave: a PySpark engine for gridded time series, with a text toolbox in ``llm``."""
