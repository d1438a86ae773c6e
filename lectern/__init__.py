"""lectern: a PySpark-native engine for untidy tables, document search and entity resolution."""

__version__ = "0.1.0"
