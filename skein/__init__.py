"""skein: a Spark-first engine for indexing and searching source code and text."""

__version__ = "0.1.0"
