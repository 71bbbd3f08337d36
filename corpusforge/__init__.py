"""corpusforge: parallel-corpus preparation, comparison and scoring as Spark
DataFrame jobs."""

__version__ = "0.1.0"
