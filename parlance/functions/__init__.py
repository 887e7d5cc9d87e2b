"""Part of the parlance package."""
