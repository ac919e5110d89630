"""Spark-native analytics over software-repository history.

Every operator is a plain ``DataFrame -> DataFrame`` function; nothing is
executed before an action, except where an iterative operator must cut its
lineage (see :mod:`commitloom.runtime`).
"""
