"""lexisieve: Spark-native lexicon text detection and corpus analytics."""
