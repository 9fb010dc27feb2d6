"""Analytics over project documents on Spark: retrieval, relational tracking, extraction and routing."""
