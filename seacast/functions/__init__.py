"""Column expressions: note parsing, time, direction, solar day, text."""
