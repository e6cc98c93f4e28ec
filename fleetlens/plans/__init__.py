"""Plan-shaping helpers: hot-key slices, as-of lookups, shared folders, numbering."""
