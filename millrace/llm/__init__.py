"""Operators for preparing training text, each a Spark job over whole tables.

Nothing else in the library imports this subpackage.  Every operator takes a
DataFrame plus column names, so extra columns in the input never clash.
"""
