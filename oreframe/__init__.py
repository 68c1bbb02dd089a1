"""Analytics over filings of listed resource companies, as Spark jobs."""
