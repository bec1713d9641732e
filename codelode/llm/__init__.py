"""Training-data operators over code and text corpora; nothing outside this package imports it."""
