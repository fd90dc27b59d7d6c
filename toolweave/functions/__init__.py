"""Part of toolweave."""
