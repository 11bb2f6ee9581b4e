"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface, a thin query ``opN_<name>`` over whole
tables, and its oracle SQL where SQL can express it; ``registry`` lists them.
"""
