"""Study definitions and the query catalogue."""
