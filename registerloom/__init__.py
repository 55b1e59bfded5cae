"""registerloom: a Spark-native engine for registry and knowledge-graph data."""
