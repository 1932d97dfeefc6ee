"""Physical plans: bins, ordered scans, components."""
