"""tesserae: full-text retrieval and corpus statistics on Spark DataFrames."""

__version__ = "0.1.0"
