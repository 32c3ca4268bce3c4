"""The analytical queries, each from a flight DataFrame to a DataFrame."""
