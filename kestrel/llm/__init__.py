"""Operators of a training-data pipeline (tokens, language, dedup, packing).

Nothing outside this folder imports it. ``queries.py`` holds the contract
queries; every other module is one operator with its own interface.
"""
