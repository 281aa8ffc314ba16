"""PySpark-native text analytics for digitised newspapers."""
