"""Glasswing: a Spark-native engine for catalogues of files and what was found in them."""
