"""Catalogue similarity as Spark DataFrame jobs.

Every operator is a function ``f(DataFrame, ...) -> DataFrame`` or a Column
builder; there is no global session and no hidden state.
"""
