"""Monthly device-inventory and connection-log ETL as plain Spark DataFrame code."""

__version__ = "0.1.0"
