"""Training-data operators: one module an operator, each with its own general interface.

Nothing else in the library imports this subpackage.  ``queries`` registers the thin ``opN_<name>``
queries that apply the operators to the whole test tables.
"""
