"""Where bars come from: derived from tables, generated, or read."""
