"""textmill: a corpus engine for language-model training data, written for Spark's DataFrame and SQL APIs."""
