"""inkwell: Spark-native analytics over governed text corpora."""
