"""Corpus operators for training-data pipelines.

Ten operators over ``documents``, ``pages``, ``benchmark`` and ``labels``; nothing
else in the library imports this subpackage.  Every operator is a function of
DataFrames with its own general interface; ``queries.py`` applies each one to its
whole table under the ``opN_<name>`` contract.
"""
