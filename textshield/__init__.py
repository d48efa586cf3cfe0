"""A Spark-native engine that screens text for language models and prepares training corpora."""
