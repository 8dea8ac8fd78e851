"""Models, the completeness ledger, reports and the query catalogue."""
