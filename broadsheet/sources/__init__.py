"""Source readers and sinks."""
