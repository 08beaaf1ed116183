"""Column functions: everything here takes and returns a ``Column``."""
