"""bytestrata: a Spark-native engine for collections of byte content."""
