"""A PySpark analytics library for enforcement-ticket style event data."""
