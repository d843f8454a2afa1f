"""No streaming operators: the inventory holds batch work only (see README)."""
