"""A Spark-native engine for search and change analytics over catalogues of dated, placed observations."""
