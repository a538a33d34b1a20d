"""Table views, file sources and sinks."""
