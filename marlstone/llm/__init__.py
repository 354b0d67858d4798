"""Operators for training-data pipelines; nothing outside this folder imports it.

Each ``opN_*`` module holds one operator with its own general interface and a
thin query of the same name; ``registry`` lists the queries and their SQL.
"""
