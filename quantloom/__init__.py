"""Market and portfolio analytics as Spark DataFrame operators."""
