"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  ``registry`` lists the
queries that apply the operators to whole tables.
"""
