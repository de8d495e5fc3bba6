"""Mining plans and the query catalogue."""
