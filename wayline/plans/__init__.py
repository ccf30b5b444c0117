"""Plan-shaping helpers: skew-safe scans, as-of, interval and grid joins."""
