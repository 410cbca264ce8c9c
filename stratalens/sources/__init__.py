"""Image sources and archive sinks."""
