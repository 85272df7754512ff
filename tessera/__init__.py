"""tessera: Spark-native analytics over annotated text corpora."""
