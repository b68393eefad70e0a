"""Operators for preparing language-model training data on Spark.

Nothing else in the package imports this subpackage.  ``queries.py`` holds the
registered queries; each operator has a module of its own.
"""
