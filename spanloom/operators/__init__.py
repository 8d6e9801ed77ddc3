"""Operators: ``DataFrame -> DataFrame`` functions, to be chained by ``df.transform``."""
