"""larder: a PySpark-native analytics engine for product catalogs, recipes and text corpora."""

__version__ = "0.1.0"
