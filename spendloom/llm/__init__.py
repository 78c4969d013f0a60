"""Operators for preparing language-model training data.

Nothing else in the library imports this package.  Each operator is a function
from DataFrames to a DataFrame; ``entry`` registers one query per operator.

All operators read only the columns they name, so further columns of any name
do no harm.  A null text counts as the empty text.
"""
