"""sweepgrid: a Spark-native engine for rotational-sweep volumes, point clouds and surfaces."""

__version__ = "0.1.0"
