"""Sluice: dataflow analytics on PySpark.

A program is a network of named processes whose ports carry DataFrames,
scalars or streams.  The package binds parameters, infers the edges between
processes, orders and checks the network, recomputes what changed and reports
status as ordinary tables.
"""

__version__ = "0.1.0"
