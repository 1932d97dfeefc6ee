"""Training-data operators: packing, deduplication, scanning, scoring, tokenizing.

Every operator takes a DataFrame, reads only the columns it names (any other
column, whatever its name, is ignored) and returns a new DataFrame keyed by the
row id. Nothing outside this subpackage imports it.
"""
