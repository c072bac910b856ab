"""Data tests, verification of values, and checks of whole graphs; all are queries that return what is wrong."""
