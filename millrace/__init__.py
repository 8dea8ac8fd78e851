"""Event-telemetry lakehouse on Spark with a completeness ledger that proves what landed."""
