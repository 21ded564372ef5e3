"""Trade-surveillance analytics for prediction markets, written as Spark DataFrame operators."""
