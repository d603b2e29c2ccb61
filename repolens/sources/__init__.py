"""Sources and sinks: corpus scans, commit logs, manifests, the snapshot store."""
