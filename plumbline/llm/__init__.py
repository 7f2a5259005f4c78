"""Training-data operators: tokenising, deduplication, quality, packing, chat, WARC.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames, selects the columns it needs under its own names (so extra
or clashing input columns do no harm) and states its null, empty, tie and
repeated-row rules in its docstring.
"""
