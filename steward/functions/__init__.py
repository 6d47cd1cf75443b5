"""Column-level building blocks: seeds, text states, checks, validators."""
