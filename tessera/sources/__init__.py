"""Sources and sinks: typed telemetry, envelopes, document folders, audit logs, connector rows."""
