"""packetloom: a Spark-native document-evidence engine."""
