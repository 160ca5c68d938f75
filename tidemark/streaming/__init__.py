"""The usage log as a stream."""
