"""Glossara: a PySpark-native lexical analytics engine."""
