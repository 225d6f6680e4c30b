"""queryloom: declarative reporting queries and data preparation on Spark."""
