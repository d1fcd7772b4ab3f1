"""ledgerloom: find and cut named sections out of large sets of annual filings with Spark."""
