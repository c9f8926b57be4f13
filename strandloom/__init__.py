"""Spark-native analytics over pangenome graphs: walks, blocks, nodes and their edits as DataFrames."""

__version__ = "0.1.0"
