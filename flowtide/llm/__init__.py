"""Operators for large-scale training-data pipelines.

Nothing outside this folder (and the pipeline script at the top) imports it. Every operator takes DataFrames and
returns DataFrames; ``queries.py`` applies each to a whole table.
"""
