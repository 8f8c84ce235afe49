"""A PySpark analytics engine for security telemetry."""
