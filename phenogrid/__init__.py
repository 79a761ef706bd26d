"""Per-feature statistics for large sample x feature measurement tables, as DataFrame operators."""
