"""Reusable DataFrame operators: gates, window presence, sequence gaps, trees, slot decoding."""
