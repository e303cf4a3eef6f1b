"""PySpark-native analytics over ledger data."""
