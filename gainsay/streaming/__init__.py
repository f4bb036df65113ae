"""Rules over logs that are still being written."""
