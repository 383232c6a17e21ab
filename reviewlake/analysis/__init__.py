"""Source code as tables: symbols, imports and function complexity."""
