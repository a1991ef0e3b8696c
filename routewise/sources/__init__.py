"""Sources and sinks: table scans, stand-in entities, landing ingest, exports."""
