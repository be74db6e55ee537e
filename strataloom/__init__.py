"""A Spark-first engine for analysing source repositories and text corpora as tables."""
