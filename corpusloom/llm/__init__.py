"""Operators for training-data pipelines: scans, scores, classifiers, deduplication, encoding.

Each operator module has a general interface on DataFrames; `queries` holds the thin registered
queries over the given tables and `oracles` their SQL. Nothing else in the library imports this
package.
"""
