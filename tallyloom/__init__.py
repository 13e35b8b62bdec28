"""tallyloom: table, text, series and graph analytics as PySpark DataFrame transformations.

Every public operator takes DataFrames or Columns and returns a DataFrame or a
Column.  Nothing is collected to the driver except values whose size is bounded
by a parameter of the call.
"""
