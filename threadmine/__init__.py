"""threadmine: curate, index, search and evaluate threaded posts with Spark DataFrames."""

__version__ = "0.1.0"
