"""toolweave: Spark-native operators for tool catalogues and tool-calling conversations."""
