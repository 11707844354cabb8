"""A PySpark-native engine for curating, labelling, splitting and evaluating text-to-code datasets."""

__version__ = "0.1.0"
