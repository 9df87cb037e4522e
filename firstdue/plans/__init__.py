"""Reports, map feeds and the catalogue of checked queries."""
