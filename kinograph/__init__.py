"""A Spark-native engine for typed spatio-temporal queries over tracking and event tables."""
