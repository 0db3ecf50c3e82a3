"""A Spark-native engine for pools of candidate transcripts."""
