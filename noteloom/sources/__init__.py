"""Input adapters and sinks."""
