"""DataFrame -> DataFrame operators over readings, metrics and events."""
