"""PySpark-native analytics for conversation-quality data and training-corpus preparation."""
