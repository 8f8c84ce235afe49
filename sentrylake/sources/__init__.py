"""Sources and sinks: JSON lines, archives of documents, rules, bundles and partitioned tables."""
