"""End-to-end plans: the census of raw files, and the driver's queries."""
