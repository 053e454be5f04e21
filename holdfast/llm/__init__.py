"""Operators for training-data pipelines. Nothing outside this subpackage imports it.

One module per operator; ``queries`` registers them. Every operator takes and returns DataFrames.
"""
