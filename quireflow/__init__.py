"""quireflow: Spark-native analytics over readings of scanned documents."""

__version__ = "0.1.0"
