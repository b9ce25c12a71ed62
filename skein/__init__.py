"""skein: kernel sketches and multi-model logistic learning on Spark DataFrames."""

__version__ = "0.1.0"
