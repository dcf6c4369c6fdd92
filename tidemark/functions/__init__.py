"""Column expressions: identifiers, money, clocks, text and pricing rules."""
