"""The folds as Structured Streaming: stateful processors, event-time windows, state readers."""
