"""textpulse: text and reader-engagement analytics on Spark DataFrames.

Sub-packages
------------
functions   column expressions (classes, name lists, tokens, markup, vectors)
operators   DataFrame -> DataFrame operators (profiles, tests, TF-IDF, LSA, learning)
sources     readers and writers (CSV, XML, Kafka, word vectors, Parquet)
plans       composite jobs made of operators
streaming   Structured Streaming jobs
"""

__version__ = "0.1.0"
