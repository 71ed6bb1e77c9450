"""driftwell: Spark-native residual and convergence analytics on long panels of price-like series."""
