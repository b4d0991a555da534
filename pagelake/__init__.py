"""pagelake: a PySpark-native document-retrieval and text-analytics engine."""
