"""Plans: logical tables over the driver's data and the registered checks."""
