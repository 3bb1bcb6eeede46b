"""Operators over DataFrames; every one is lazy unless its docstring says otherwise."""
