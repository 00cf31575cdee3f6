"""PySpark toolkit for code/text corpora, parallel pairs, vector datastores and scoring."""
