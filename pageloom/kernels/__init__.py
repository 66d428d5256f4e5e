"""Plain Python functions on one value, for use inside Arrow functions: JSON texts, script literals, page state."""
