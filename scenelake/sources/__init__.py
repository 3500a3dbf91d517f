"""Sources and sinks: run logs, move specifications, file listings, result and cache tables."""
