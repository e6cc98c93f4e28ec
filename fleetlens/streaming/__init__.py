"""The timers and transitions as Structured Streaming queries."""
