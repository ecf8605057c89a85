"""PySpark-native analytics for time- and size-resolved instrument measurements."""
