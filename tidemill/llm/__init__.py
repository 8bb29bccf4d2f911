"""Operators for preparing language-model training data, at cluster scale.

Every operator takes and returns DataFrames.  Nothing else in the library
imports this subpackage.
"""
