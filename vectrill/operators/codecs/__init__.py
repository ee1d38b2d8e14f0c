"""Compact codes of vectors. Every codec has ``fit``, ``encode`` and ``decode`` over DataFrames."""
