"""The survey studies themselves, from raw survey columns to published tables.

Each function takes the raw tables as DataFrames and is put together from the
general operators; codes and coefficients are in ``fixed_values``.
"""
