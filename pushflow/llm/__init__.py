"""Training-data operators: tokenising, scoring, search, dedup, decontamination and cleaning.

Nothing else in the library imports this subpackage.
"""
