"""Column expressions: geometry, arrays, control signals, tokens and text."""
