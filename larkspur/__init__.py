"""A PySpark-native analytics engine for venue, item and community data."""
