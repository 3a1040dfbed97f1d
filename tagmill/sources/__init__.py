"""Sources and sinks: command lines, the event store, and views of other tables as events."""
