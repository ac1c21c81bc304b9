"""gneiss: Spark-native analytics over code graphs, findings and text."""
