"""corpuslens: document ETL and lexical retrieval on Spark DataFrames."""

__version__ = "0.1.0"
