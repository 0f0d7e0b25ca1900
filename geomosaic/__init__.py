"""geomosaic: a Spark-native engine for spatial object analytics."""
