"""End-to-end compositions and the queries run on the driver tables."""
