"""Plan helpers: skew-proof ordered scans, halo windows, range / as-of joins, tiled pair joins."""
