"""tessera: a PySpark-native market-intelligence analytics engine."""
