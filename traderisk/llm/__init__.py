"""Training-data operators: documents in, decisions, counts, files and packed sequences out.

Nothing else in the library imports this subpackage.
"""
