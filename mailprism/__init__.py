"""mailprism: a Spark-native analytics engine for mail forensics and text corpora."""
