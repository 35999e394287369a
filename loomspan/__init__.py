"""loomspan: a PySpark-native retrieval, stream-segmentation and editorial analytics engine."""

__all__ = ["__version__"]
__version__ = "0.1.0"
