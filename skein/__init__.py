"""skein: a PySpark-native engine for code graphs and the text around them."""

__version__ = "0.1.0"
