"""Operators for preparing language-model training data.

Nothing else in ``cardloom`` imports this subpackage.  Each module holds one
operator with its general interface; :mod:`cardloom.llm.entry_queries` holds
the thin ``opN_<name>`` queries over the driver's tables.
"""
