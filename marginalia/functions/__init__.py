"""Functions of one text or one row: patterns, names, detection and parsing. Operators lift them to DataFrames."""
