"""Sources: bindings of the driver tables and seeded generators."""
