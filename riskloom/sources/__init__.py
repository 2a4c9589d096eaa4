"""Sources and sinks: landing packages, lineage, versioned snapshots, and the synthetic price source."""
