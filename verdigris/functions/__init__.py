"""Column-level helpers (pure ``Column -> Column``) and aggregate helpers."""
