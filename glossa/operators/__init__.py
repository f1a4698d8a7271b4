"""Relational operators over tokens, mentions, graphs, counters and datasets."""
