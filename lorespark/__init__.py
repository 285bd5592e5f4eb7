"""Analytics over time-coded text corpora, as DataFrame operators for Spark."""
