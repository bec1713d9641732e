"""codelode: Spark-native code, text and vector analytics over plain tables."""
