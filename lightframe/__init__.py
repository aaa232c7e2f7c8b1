"""Spark-first operators over large media and event catalogues."""
