"""PySpark-native geospatial feature and tile engine."""
