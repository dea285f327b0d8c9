"""keyfold: duplicate-aware equi-join analytics for Spark."""
