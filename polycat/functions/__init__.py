"""Column functions on weight systems and keys, all of them native expressions."""
