"""A Spark-native engine for terrain, drainage networks and point clouds."""
