"""Part of the Spark-native dataset engine."""
