"""A PySpark-native engine for three-dimensional X-ray diffraction data."""
