"""Column expressions: no shuffles, usable inside any select."""
