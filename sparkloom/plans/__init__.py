"""From statements to plans: the dialect, the catalog and changes to tables."""
