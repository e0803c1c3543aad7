"""Part of the abyssal engine."""
