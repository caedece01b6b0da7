"""fraudlens: a PySpark-native nearest-neighbour transaction scoring engine."""
