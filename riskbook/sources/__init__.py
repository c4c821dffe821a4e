"""Sources and sinks: fixture book from the driver tables, policy files, model bundles."""
