"""No streaming operators: the inventory has none (see README)."""
