"""Sources and sinks: typed readers, writers, and adapters for the driver tables."""
