"""A PySpark-native engine for ownership and due-diligence data."""
