"""millrace: a Spark-native library of DataFrame operators for entity and event intelligence."""
