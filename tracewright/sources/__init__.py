"""Sources and sinks of event logs."""
