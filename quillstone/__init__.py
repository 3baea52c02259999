"""Document-field analytics on Spark: ingest, extract, normalise, validate, admit, search and score header records."""

__version__ = "0.1.0"
