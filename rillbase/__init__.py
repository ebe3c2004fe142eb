"""A PySpark-native relational and corpus-preparation engine."""
