"""quire: PDF corpora and training-data pipelines as Spark DataFrames."""

__version__ = "0.1.0"
