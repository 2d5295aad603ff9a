"""tessera: a PySpark-native analytics engine built on the public DataFrame, SQL and Structured Streaming APIs."""
