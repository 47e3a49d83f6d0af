"""Message and table sources and sinks."""
