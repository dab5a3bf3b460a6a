"""End-to-end jobs over the store: poll cycle, contract sync, stale sweep, landing validation."""
