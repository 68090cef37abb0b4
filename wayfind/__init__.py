"""wayfind: place search, reverse geocoding and index building as Spark plans."""
