"""tekstra: a Spark-native engine for preparing language-model text corpora."""
