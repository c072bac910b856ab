"""A PySpark analytics engine: a graph of commerce relations, column functions, data tests and verification."""
