"""lektor: a Spark-native engine for analysing document corpora."""
