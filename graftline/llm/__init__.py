"""Training-data operators (chat, decontamination, scoring, packing, dedup, ...).

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the modules named after an operator hold its general interface and
``queries`` holds the thin registered queries.
"""
